"""Byte-pair encoding of whole texts with a public vocabulary, by numpy matrices.

Texts are cut into pieces by the vocabulary's pattern; the distinct pieces of a batch are put, by length, into padded
matrices of byte ids. In each round every row merges its leftmost pair of least rank; the pair is looked up in an open
hash table of all merges, and rows are compacted by one column. Rows without a pair leave the matrix. A piece longer than
the widest matrix (a run of marks or of one word without a blank, up to a whole text) is a row of its own, which merges all
places of its least pair in one round if none of the pairs that arise on the way has as low a rank, and else the leftmost
place only; so the order of merges is the same.

Defined results: null and empty texts give an empty list; texts of any length are encoded whole; lone surrogates, which
aren't valid text, are encoded as the replacement character; special tokens have no meaning, their spelling is text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that goes with the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PAD = -1
FAR = np.iinfo(np.int32).max
WIDEST = 512


class PairTable:
    """Hash table (linear probing) of the mergeable pairs: two ids -> the merged id, which is the rank as well."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(len(left) * 2 + 1))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, FAR, np.int32)
        keys, todo = left.astype(np.int64) << 32 | right, np.arange(len(left))
        slot, self.probes = self._slot(keys), 0
        while len(todo):  # all still unplaced keys try their next slot at once; one wins each free slot
            self.probes += 1
            free = self.keys[slot[todo]] == -1
            at = todo[free]
            self.keys[slot[at]] = keys[at]
            won = self.keys[slot[todo]] == keys[todo]
            self.values[slot[todo[won]]] = merged[todo[won]]
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged ids of the pairs; FAR where a pair isn't mergeable."""
        keys = left.astype(np.int64) << 32 | right
        keys[(left < 0) | (right < 0)] = -2
        flat = keys.ravel()
        slot = self._slot(flat)
        out = np.full(flat.shape, FAR, np.int32)
        todo = np.arange(len(flat))
        for _ in range(self.probes):
            there = self.keys[slot[todo]]
            hit = there == flat[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (there != -1)]
            if not len(todo):
                break
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
        return out.reshape(keys.shape)


class Encoder:
    def __init__(self, path: str = VOCABULARY):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() if len(t) > 1 for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.table = PairTable(*(np.array(x, np.int64) for x in zip(*pairs)))
        self.pattern = regex.compile(PATTERN)

    def pieces(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def encode_pieces(self, pieces: list[str]) -> list[np.ndarray]:
        """The ids of each piece."""
        raw = [p.encode("utf-8", "replace") for p in pieces]
        out: list[np.ndarray] = [np.empty(0, np.int32)] * len(raw)
        by_width: dict[int, list[int]] = {}
        for i, b in enumerate(raw):
            width = 4
            while width < len(b) and width < WIDEST:
                width *= 2
            by_width.setdefault(width if len(b) <= WIDEST else 0, []).append(i)
        for width, rows in by_width.items():
            if width:
                for at in range(0, len(rows), 65536 * 8 // width):
                    part = rows[at : at + 65536 * 8 // width]
                    for i, ids in zip(part, self._matrix([raw[i] for i in part], width)):
                        out[i] = ids
            else:
                for i in rows:
                    out[i] = self._long(raw[i])
        return out

    def _matrix(self, raw: list[bytes], width: int) -> list[np.ndarray]:
        m = np.full((len(raw), width), PAD, np.int32)
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = self.bytes[np.frombuffer(b"".join(raw), np.uint8)]
        row = np.repeat(np.arange(len(raw)), lengths)
        col = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        m[row, col] = flat
        done: list[np.ndarray] = [np.empty(0, np.int32)] * len(raw)
        alive = np.arange(len(raw))
        rank = self.table.rank(m[:, :-1], m[:, 1:])
        while len(alive):
            best = rank.argmin(axis=1)  # the first of the least
            r = np.arange(len(alive))
            least = rank[r, best]
            ended = least == FAR
            if ended.any():
                for i, ids in zip(alive[ended], m[ended]):
                    done[i] = ids[: np.argmax(ids == PAD)] if ids[-1] == PAD else ids
                keep = ~ended
                alive, m, rank, best, least = alive[keep], m[keep], rank[keep], best[keep], least[keep]
                r = np.arange(len(alive))
                if not len(alive):
                    break
            m[r, best] = least
            # compact: what stands behind the merged pair moves up by one
            cols = np.arange(m.shape[1] - 1)
            m = np.where(cols[None, :] > best[:, None], m[:, 1:], m[:, :-1])
            if m.shape[1] == 1:
                for i, ids in zip(alive, m):
                    done[i] = ids
                break
            cols = cols[:-1]
            rank = np.where(cols[None, :] > best[:, None], rank[:, 1:], rank[:, :-1])
            # only the pairs beside the merged id are new
            for at in (best - 1, best):
                ok = (at >= 0) & (at < rank.shape[1])
                rank[r[ok], at[ok]] = self.table.rank(m[r[ok], at[ok]], m[r[ok], at[ok] + 1])
        return done

    def _long(self, raw: bytes) -> np.ndarray:
        ids = self.bytes[np.frombuffer(raw, np.uint8)]
        while len(ids) > 1:
            rank = self.table.rank(ids[:-1], ids[1:])
            least = rank.min()
            if least == FAR:
                break
            at = np.flatnonzero(rank == least)
            # of overlapping places (a run of one id) every other one, from the left
            start = np.concatenate(([True], np.diff(at) > 1))
            run = at - np.maximum.accumulate(np.where(start, at, 0))
            at = at[run % 2 == 0]
            if len(at) > 1 and self._lowest_new(ids, at, least) <= least:
                at = at[:1]
            ids[at] = least
            ids = np.delete(ids, at + 1)
        return ids

    def _lowest_new(self, ids: np.ndarray, at: np.ndarray, merged: int) -> int:
        """The least rank of the pairs that a merged id makes with its neighbours, these merged already or not yet."""
        before, after = at[at > 0] - 1, at[at < len(ids) - 2] + 2
        left, right = np.concatenate((ids[before], [merged])), np.concatenate((ids[after], [merged]))
        made = np.full(len(left), merged, ids.dtype), np.full(len(right), merged, ids.dtype)
        return min(self.table.rank(left, made[0]).min(), self.table.rank(made[1], right).min())


def encode_texts(texts: list[str | None], encoder: Encoder, memo: dict[str, np.ndarray], most: int = 300_000) -> list[np.ndarray]:
    """The ids of each text. ``memo`` keeps the ids of up to ``most`` short pieces for the next batch."""
    cut_up = [encoder.pieces(t) if t else [] for t in texts]
    new = list({p for ps in cut_up for p in ps if p not in memo})
    now = dict(zip(new, encoder.encode_pieces(new)))
    none = np.empty(0, np.int32)
    out = [np.concatenate([now[p] if p in now else memo[p] for p in ps]) if ps else none for ps in cut_up]
    if len(memo) + len(now) > most:
        memo.clear()
    memo.update((p, ids) for p, ids in now.items() if len(p) <= 32)
    return out


def encode(df: DataFrame, *, text: str = "text", keep: list[str], vocabulary: str = VOCABULARY, counts_only: bool = False) -> DataFrame:
    """``keep`` columns and ids (array<int>), or n_tokens if ``counts_only``, of every row. One pass, without a shuffle.

    vocabulary: path of a rank file that is at the same place on every executor; other columns don't matter.
    """
    names = [f"k{i}" for i in range(len(keep))]
    src = df.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], F.col(text).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, memo = Encoder(vocabulary), {}
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            at = 0
            while at < len(texts):  # as many rows at once as make some MB of text
                end, size = at, 0
                while end < len(texts) and (end == at or size < 4_000_000):
                    size += len(texts[end] or "")
                    end += 1
                ids = encode_texts(texts[at:end], encoder, memo)
                lengths = np.fromiter(map(len, ids), np.int64, len(ids))
                if counts_only:
                    last = pa.array(lengths)
                else:
                    flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
                    last = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([c.slice(at, end - at) for c in kept] + [last], names=[*names, "out"])
                at = end

    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in src.drop("t").schema] + ["out " + ("long" if counts_only else "array<int>")])
    out = src.mapInArrow(run, schema)
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], F.col("out").alias("n_tokens" if counts_only else "ids"))
