"""Compressed token files: an adaptive context-mixing range coder over token ids.

An id is a walk down a binary tree whose leaves are the ids of the file row (the
*group*); frequent ids are near the root, and the tree's shape -- the only order-0
statistic that blocks share -- is stored once per group.  Every step down is one
binary decision that three adaptive predictions tell: the node's own (order 0), the
node's after the id before (order 1) and the node's after the two ids before
(order 2).  A prediction is a probability with a count of how often it was met, which
sets how fast it learns.  They are mixed in the logistic domain with weights that
learn too, chosen by how sure orders 1 and 2 are, and the mixture drives a binary
range coder.  All arithmetic is on whole numbers, so every machine decodes alike.

The ids are cut into blocks of ``BLOCK``; every block starts with fresh
statistics and carries the CRC-32 of its ids, so blocks decode independently and
damage is noticed.  Spark's tasks code them in the JVM, by the functions of
``TokenCoder.java``; ``encode_blocks`` and ``decode_blocks`` are the same in numpy (many
blocks in step), to the same bytes and without Spark.  A group
holds whole documents: their ids and lengths and the coded blocks.  Documents
are range-partitioned by id (and text, so that one id's rows can be split), so
files and groups follow in ascending order; the position of a document is its
file's base (one total per file reaches the driver) plus its place in the file.

Defined cases: null and empty texts hold only the end id; rows of the same id
follow in a fixed order (by text hash) and each has a row; null ids come first;
empty tables give an empty table; ids from 2 ** 20 on are refused; texts of any
length are encoded whole, a longer one only makes its group longer.
"""

from __future__ import annotations

import functools
import heapq
import json
import os
import re
import tempfile
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.llm.common import shared_path, small_batches

BLOCK = 2_048
LANES = 3_072                        # a group's blocks, 72 KB of statistics each
GROUP_IDS = 6_000_000
CACHE_CHUNKS = 500_000
TEXT_BYTES = 4 << 20                 # of texts that are encoded together
# chunks of ASCII and Latin-1 letters, of digits and of marks; normal forms leave them alone
_PLAIN = r"^[!-~À-ÖØ-öø-ÿ]+$"
# fixed value: the pre-tokenizer's pattern on the lower case of these
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
_U = np.uint64
_LEAST = _U(1 << 48)                 # the coder's range is at least this before every other decision
_MOST_IDS = 1 << 20
_BITS = (12, 14, 14)                 # bits of a lane's tables of orders 0, 1 and 2
_LANE = sum(1 << b for b in _BITS)
_WEIGHTS = (1 << 16, 1 << 14, 1 << 14)
_RATE = 10                           # weights move by error x input / 2 ** _RATE


def _entry_tables() -> tuple[np.ndarray, ...]:
    """Of a table entry (12 bits of probability, 4 of count): its logit by probability, and the entry
    that follows a 0 and a 1; and the probability (16 bits) of a mixed logit."""
    e = np.arange(1 << 16)
    p, n = e >> 4, e & 15
    x = (np.arange(1 << 12) + 0.5) / 4096
    logit = np.rint(np.log(x / (1 - x)) * 256).astype(np.int32)
    share = (65536 / (n + 1.6)).astype(np.int64)
    after = [(p + (((bit * 4095 - p) * share) >> 16) << 4) | np.minimum(n + 1, 15) for bit in (0, 1)]
    mixed = np.arange(-2047, 2048) / 256
    prob = np.clip(np.rint(65536 / (1 + np.exp(-mixed))), 32, 65536 - 32).astype(np.uint64)
    return logit, np.concatenate(after).astype(np.uint16), prob


_LOGIT, _AFTER, _PROB = _entry_tables()


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Depth of each id's leaf in a tree of least expected depth (0: the id doesn't occur)."""
    ids, out = np.flatnonzero(counts), np.zeros(len(counts), np.uint8)
    heap = [(int(counts[i]), k) for k, i in enumerate(ids)]
    heapq.heapify(heap)
    above = np.zeros(2 * len(ids), np.int64)
    for n in range(len(ids), 2 * len(ids) - 1):
        (x, i), (y, j) = heapq.heappop(heap), heapq.heappop(heap)
        above[i] = above[j] = n
        heapq.heappush(heap, (x + y, n))
    depth = np.zeros(2 * len(ids), np.int64)
    for k in range(2 * len(ids) - 3, -1, -1):
        depth[k] = depth[above[k]] + 1
    out[ids] = np.maximum(depth[:len(ids)], 1)
    return out


class _Tree:
    """The tree with leaves at given depths, those of lower ids first: nodes are numbered from
    the root level by level.

    ``child``: at 2 * node + decision the next node, or ~id of a leaf; ``start``: of each id the
    first of its steps in ``node``, ``bit`` and ``last`` (the step that ends in the leaf)."""

    def __init__(self, lengths: np.ndarray):
        ids = np.flatnonzero(lengths)
        ids = ids[np.lexsort((ids, lengths[ids]))]
        depth = lengths.astype(np.int64)
        leaves = np.bincount(depth[ids])
        child, above, side = [], [np.array([-1])], [np.array([0])]
        up, turn = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        base, inner, nodes, first = 0, 1, 1, 0
        for d in range(1, len(leaves)):
            place = np.arange(2 * inner)             # below the nodes of the level before: leaves, then nodes
            own = ids[first:first + leaves[d]]
            below = np.where(place < len(own), 0, nodes + place - len(own))
            below[:len(own)] = ~own
            if len(ids) == 1:
                below[:], place = ~own[0], place[:1]
            up[own], turn[own] = base + place[:len(own)] // 2, place[:len(own)] & 1
            child.append(below)
            above.append(base + place[len(own):] // 2)
            side.append(place[len(own):] & 1)
            base, inner, first = nodes, len(place) - len(own), first + len(own)
            nodes += inner
        self.child = np.concatenate(child)
        above, side = np.concatenate(above), np.concatenate(side)
        self.start = np.concatenate([[0], np.cumsum(depth)])
        self.mix = np.arange(nodes, dtype=np.uint32) * np.uint32(0x9E3779B1)
        self.node, self.bit = np.zeros(self.start[-1], np.int64), np.zeros(self.start[-1], np.int64)
        self.last = np.zeros(self.start[-1], bool)
        at, node, bit = self.start[ids] + depth[ids] - 1, up[ids], turn[ids]
        self.last[at] = True
        while len(at):
            self.node[at], self.bit[at] = node, bit
            at, bit, node = at - 1, side[node], above[node]
            rest = node >= 0
            at, bit, node = at[rest], bit[rest], node[rest]
        self.step = self.node << 2 | self.bit << 1 | self.last


class _Lanes:
    """Statistics and coder state of blocks that are coded in step."""

    def __init__(self, n: int):
        self.table = np.full(n * _LANE, 2048 << 4, np.uint16)
        self.weight = np.repeat(np.array(_WEIGHTS, np.int32), 16 * n)
        self.context, self.prev = np.zeros((2, n), np.uint32), np.zeros(n, np.uint32)
        self.low, self.range = np.zeros(n, np.uint64), np.full(n, 2 ** 64 - 1, np.uint64)
        self._number(n)

    def _number(self, n: int) -> None:
        self.n = n
        first = np.cumsum([0, *(1 << b for b in _BITS[:2])])[:, None]
        self.base, self.row = np.arange(n) * _LANE + first, np.arange(n) << 4
        self.order = np.arange(3)[:, None] * (16 * n)
        # what a decision works on, by order
        self.at, self.by, self.index = np.empty((3, 3, n), np.int64)
        self.entry = np.empty((3, n), np.uint16)
        self.logit, self.own, self.work = np.empty((3, 3, n), np.int32)
        self.hash, self.sure = np.empty((2, n), np.uint32), np.empty((2, n), np.uint16)
        self.total, self.wrong = np.empty((2, n), np.int32)
        self.prob, self.bound, self.part, self.mask = np.empty((4, n), np.uint64)

    def keep(self, lanes: np.ndarray) -> None:
        """Goes on with some of the lanes."""
        self.table = self.table.reshape(self.n, _LANE)[lanes].ravel()
        self.weight = self.weight.reshape(3, self.n, 16)[:, lanes].ravel()
        self.context = self.context[:, lanes].copy()
        for name in ("prev", "low", "range"):
            setattr(self, name, getattr(self, name)[lanes])
        self._number(len(lanes))

    def predict(self, node: np.ndarray, mix: np.ndarray) -> np.ndarray:
        """The share of each lane's range that stands for a 1 at ``node`` (``mix``: its hash)."""
        at, work = self.at, self.work
        np.bitwise_and(node, (1 << _BITS[0]) - 1, out=at[0])
        at[0] += self.base[0]
        np.bitwise_xor(self.context, mix, out=self.hash)
        self.hash *= np.uint32(0x85EBCA77)
        self.hash >>= np.uint32(32 - _BITS[1])
        np.add(self.hash, self.base[1:], out=at[1:])
        self.table.take(at, out=self.entry, mode="clip")
        np.right_shift(self.entry, 4, out=self.index)
        _LOGIT.take(self.index, out=self.logit, mode="clip")
        np.bitwise_and(self.entry[1:], 15, out=self.sure)
        np.minimum(self.sure, 3, out=self.sure)
        self.sure[0] <<= 2
        self.sure[0] += self.sure[1]
        np.add(self.row, self.sure[0], out=self.by[0])
        np.add(self.by[0], self.order[1:], out=self.by[1:])
        self.weight.take(self.by, out=self.own, mode="clip")
        np.multiply(self.own, self.logit, out=work)
        np.add.reduce(work, axis=0, dtype=np.int32, out=self.total)
        self.total >>= 16
        self.total += 2047
        _PROB.take(self.total, out=self.prob, mode="clip")
        np.right_shift(self.range, _U(16), out=self.bound)
        self.bound *= self.prob
        return self.bound

    def learn(self, bit: np.ndarray) -> None:
        """Narrows the ranges to the decisions and moves predictions and weights towards them."""
        high = bit << 16
        np.subtract(high, self.prob.view(np.int64), out=self.wrong, casting="unsafe")
        self.wrong >>= 4
        np.multiply(self.logit, self.wrong, out=self.work)
        self.work >>= _RATE
        self.work += self.own
        self.weight[self.by] = self.work
        np.add(self.entry, high, out=self.index)
        _AFTER.take(self.index, out=self.entry, mode="clip")
        self.table[self.at] = self.entry
        # a 1: the range is the bound; a 0: what is above it
        np.subtract(bit, 1, out=self.mask.view(np.int64))
        np.bitwise_and(self.bound, self.mask, out=self.part)
        self.low += self.part
        np.subtract(self.range, self.bound, out=self.range)
        self.range ^= self.bound
        self.range &= self.mask
        self.range ^= self.bound

    def follow(self, lanes: np.ndarray, ids: np.ndarray) -> None:
        """These lanes have come to a leaf: the contexts of their next id."""
        own = (ids + 1).astype(np.uint32)
        self.context[1, lanes] = (self.prev[lanes] * np.uint32(0x2545F491)) ^ (own * np.uint32(0x9E3779B1))
        self.context[0, lanes] = own * np.uint32(0x27D4EB2F)
        self.prev[lanes] = own

    def shift(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Lanes that move 16 bits on, and these bits, until every range is large again."""
        at = np.flatnonzero(self.range < _LEAST)
        while len(at):
            low, r = self.low[at], self.range[at]
            settled = ((low ^ (low + r)) >> _U(48)) == 0
            r = np.where(settled, r, (_U(0) - low) & (_LEAST - _U(1)))     # else cut the range at the carry
            word = (low >> _U(48)).astype(np.uint16)
            self.low[at], self.range[at] = low << _U(16), r << _U(16)
            yield at, word
            at = at[self.range[at] < _LEAST]


def leaf_depths(ids: np.ndarray) -> np.ndarray:
    """``code_lengths`` of these ids (uint32)."""
    if len(ids) and int(ids.max()) >= _MOST_IDS:
        raise ValueError("ids of 2 ** 20 and more can't be coded")
    return code_lengths(np.bincount(ids))


def encode_blocks(ids: np.ndarray, block: int = BLOCK, lanes: int = LANES) -> tuple[bytes, list[tuple[int, int, bytes]]]:
    """The tree (deflated depths of its leaves) and (number of ids, CRC-32 of them, coded
    bytes) of each block of ``ids`` (uint32)."""
    lengths = leaf_depths(ids)
    out: list[tuple[int, int, bytes]] = []
    if len(ids):
        tree, n = _Tree(lengths), -(-len(ids) // block)
        parts = -(-n // lanes)
        with np.errstate(over="ignore"):
            for p in range(parts):
                out += _encode_lanes(ids[n * p // parts * block:n * (p + 1) // parts * block], tree, block)
    return zlib.compress(lengths.tobytes()), out


def _encode_lanes(ids: np.ndarray, tree: _Tree, block: int) -> list[tuple[int, int, bytes]]:
    n = -(-len(ids) // block)
    lane, at = np.arange(n), np.arange(n) * block
    end = np.minimum(at + block, len(ids))
    own = ids[at].astype(np.int64)
    step = tree.start[own]
    words, used, steps = np.zeros((n, block + 512), np.uint16), np.zeros(n, np.int64), 0
    size, tail = np.zeros(n, np.int64), np.zeros(n, np.uint64)
    busy, m = np.ones(n, bool), _Lanes(n)
    while len(lane):
        now = tree.step.take(step)
        m.predict(node := now >> 2, tree.mix.take(node))
        m.learn(now >> 1 & 1)
        for i, word in m.shift() if steps & 1 else ():
            words[lane[i], used[i]] = word
            used[i] += 1
        steps += 1
        if steps % 64 == 0 and used.max() + 256 > words.shape[1]:
            words = np.concatenate([words, np.zeros_like(words)], axis=1)
        leaf = np.flatnonzero(now & 1)
        step += 1
        m.follow(leaf, own[leaf])
        at[leaf] += 1
        last = leaf[at[leaf] == end[leaf]]
        over = last[busy[last]]
        size[lane[over]], tail[lane[over]] = used[over], m.low[over]
        busy[over] = False
        at[last] -= 1            # an idle lane repeats its last id, unheard, until a fifth of all are idle
        own[leaf] = ids[at[leaf]]
        step[leaf] = tree.start[own[leaf]]
        if len(over) and np.count_nonzero(busy) < 0.8 * len(busy):
            left = np.flatnonzero(busy)
            m.keep(left)
            lane, at, end, own, step, used, busy = (x[left] for x in (lane, at, end, own, step, used, busy))
    out = []
    for i in range(n):
        raw = ids[i * block:min(len(ids), (i + 1) * block)]
        rest = np.array([tail[i] >> _U(s) & _U(0xFFFF) for s in (48, 32, 16, 0)], np.uint16)
        out.append((len(raw), zlib.crc32(raw.tobytes()), words[i, :size[i]].tobytes() + rest.tobytes()))
    return out


def decode_blocks(tree: bytes, blocks: list[tuple[int, int, bytes]], lanes: int = LANES) -> np.ndarray:
    """The ids of the blocks, one after the other; raises ValueError if a checksum fails."""
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(blocks)
    parts = -(-len(blocks) // lanes)
    known = _Tree(np.frombuffer(zlib.decompress(tree), np.uint8)) if blocks else None
    with np.errstate(over="ignore"):
        for p in range(parts):
            lo, hi = len(blocks) * p // parts, len(blocks) * (p + 1) // parts
            for i, x in enumerate(_decode_lanes(blocks[lo:hi], known), lo):
                if zlib.crc32(x.tobytes()) != blocks[i][1]:
                    raise ValueError(f"block {i} is damaged: its checksum fails")
                out[i] = x
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def _decode_lanes(blocks: list[tuple[int, int, bytes]], tree: _Tree) -> list[np.ndarray]:
    n, sizes = len(blocks), np.array([b[0] for b in blocks])
    words = np.zeros((n, max(len(b[2]) for b in blocks) // 2 + 4), np.uint64)
    for i, b in enumerate(blocks):
        words[i, :len(b[2]) // 2] = np.frombuffer(b[2], np.uint16)
    code = (words[:, 0] << _U(48)) | (words[:, 1] << _U(32)) | (words[:, 2] << _U(16)) | words[:, 3]
    out = np.zeros((n, int(sizes.max()) + 1), np.uint32)
    lane, used, done, node = np.arange(n), np.full(n, 4, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    busy, m, steps = np.ones(n, bool), _Lanes(n), 0
    while len(lane):
        # a 1 is the lower part of the range
        bit = (code - m.low < m.predict(node, tree.mix.take(node))).astype(np.int64)
        m.learn(bit)
        steps += 1
        for i, _ in m.shift() if steps % 2 == 0 else ():
            # damaged bytes may ask for more than there is; the checksum tells
            code[i] = (code[i] << _U(16)) | words[lane[i], np.minimum(used[i], words.shape[1] - 1)]
            used[i] += 1
        node = tree.child.take(2 * node + bit)
        leaf = np.flatnonzero(node < 0)
        own = ~node[leaf]
        node[leaf] = 0
        m.follow(leaf, own)
        out[lane[leaf], done[leaf]] = own
        done[leaf] += 1
        over = leaf[done[leaf] >= sizes[lane[leaf]]]
        done[over] = sizes[lane[over]]           # what an idle lane still decodes goes to a spare column
        busy[over] = False
        if len(over) and np.count_nonzero(busy) < 0.8 * len(busy):
            left = np.flatnonzero(busy)
            m.keep(left)
            lane, used, done, node, code, busy = (x[left] for x in (lane, used, done, node, code, busy))
    return [out[i, :size].copy() for i, size in enumerate(sizes)]


class Tokenizer:
    """A ``tokenizers`` file that lower-cases, drops white space and splits words as
    ``_WORDS`` does (other files are refused).

    Nothing is joined across white space, so a chunk between white space is encoded
    alike wherever it stands; a chunk of ASCII and Latin-1 letters, digits and marks
    further falls into words that are.  The distinct chunks of a batch are found and split
    as Arrow columns; each distinct word, and each other chunk, goes through the library
    once (bounded cache), and a batch's ids are gathered from there."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer as Library

        spec = json.load(open(path, encoding="utf-8"))
        steps = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        split = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0].get("pattern", {}).get("Regex")
        wanted = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        if steps != ["NFC", "Replace", "Lowercase"] or split != wanted:
            raise ValueError("the file's normalizer or pre-tokenizer is not the expected one")
        # a chunk with the first two characters of an added token goes through the library whole
        self.added = "|".join(sorted({re.escape(t["content"][:2]) for t in spec["added_tokens"]}))
        self.library = Library.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        suffix = spec["model"]["end_of_word_suffix"]
        self.ends_word = np.zeros(self.library.get_vocab_size(with_added_tokens=True), bool)
        self.ends_word[[i for t, i in spec["model"]["vocab"].items() if t.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        """Known words and chunks, by number; the ids of number ``i`` are ``ids[ends[i]:ends[i + 1]]``."""
        self.known = pa.array([], pa.large_string())
        self.ids, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _learn(self, new: list[str]) -> None:
        """Ids of chunks or words that get the next numbers."""
        found = [e.ids for e in self.library.encode_batch_fast(new, add_special_tokens=False)]
        self._add(np.array([i for x in found for i in x], np.uint32), [len(x) for x in found])

    def _learn_words(self, new: list[str], together: int = 2_000) -> None:
        """Of words, many to a text; each word's last token, and no other, ends a word."""
        parts = [new[lo:lo + together] for lo in range(0, len(new), together)]
        for words, e in zip(parts, self.library.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) != len(words) or len(ids) != ends[-1]:
                self._learn(words)
            else:
                self._add(ids, np.diff(ends, prepend=0))

    def _add(self, ids: np.ndarray, sizes: np.ndarray | list[int]) -> None:
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        self.ids = np.concatenate([self.ids, ids])

    def _numbers(self, names: pa.Array, learn: Callable[[list[str]], None]) -> np.ndarray:
        if not len(names):
            return np.zeros(0, np.int64)
        names = names.dictionary_encode()
        number = pc.index_in(names.dictionary, value_set=self.known)
        new, number = pc.is_null(number), pc.fill_null(number, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        if (fresh := names.dictionary.filter(new)):
            learn(fresh.to_pylist())
            number[number < 0] = len(self.known) + np.arange(len(fresh))
            self.known = pa.concat_arrays([self.known, fresh])
        return number[names.indices.to_numpy(zero_copy_only=False)]

    def _words(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words of chunks that match ``_PLAIN``, and the words of each chunk."""
        odd = pc.match_substring(chunks, "'").to_numpy(zero_copy_only=False)
        # an apostrophe may begin a word: these chunks are cut by the whole pattern
        lists = pc.ascii_split_whitespace(pc.replace_substring_regex(
            pc.utf8_lower(chunks.filter(pa.array(~odd))), r"([0-9]|[^a-zß-öø-ÿ0-9]+)", r" \1 "))
        cut = [_WORDS.findall(c.lower()) for c in chunks.filter(pa.array(odd)).to_pylist()]
        lists = pa.chunked_array([lists, pa.array(cut, lists.type)]).combine_chunks()
        n_words = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        names = lists.flatten()
        number = np.full(len(names), -1, np.int64)
        full = pc.not_equal(names, "").to_numpy(zero_copy_only=False)
        number[full] = self._numbers(names.filter(pa.array(full)), self._learn_words)
        # back into the order of the chunks
        order = np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])
        size = np.empty(len(order), np.int64)
        size[order] = n_words
        first = np.empty(len(order), np.int64)
        first[order] = np.cumsum(n_words) - n_words
        at = _runs(first, size)
        keep = full[at]
        return number[at][keep], _sums(keep, size)

    def encode_column(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by the end id, and how many each text has."""
        if len(self.known) > CACHE_CHUNKS:
            self._forget()
        # of Python's and Unicode's white space only what is ASCII to both the library and Arrow
        lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        chunks = lists.flatten().dictionary_encode()
        of, names = chunks.indices.to_numpy(zero_copy_only=False), chunks.dictionary
        plain = pc.match_substring_regex(names, _PLAIN)
        if self.added:
            plain = pc.and_(plain, pc.invert(pc.match_substring_regex(names, self.added)))
        plain = plain.to_numpy(zero_copy_only=False)
        words, n_words = self._words(names.filter(pa.array(plain)))
        rest = self._numbers(names.filter(pa.array(~plain)), self._learn)
        # ids of each distinct chunk: plain ones first, then the others, one "word" each
        number, per = np.concatenate([words, rest]), np.concatenate([n_words, np.ones(len(rest), np.int64)])
        size = np.diff(self.ends)[number]
        ids = self.ids[_runs(self.ends[number], size)]
        sizes = np.empty(len(names), np.int64)
        first = np.empty(len(names), np.int64)
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        sizes[order] = _sums(size, per)
        first[order] = np.cumsum(sizes[order]) - sizes[order]
        # the end id is one more chunk behind each text
        ids = np.append(ids, np.uint32(end))
        n_chunks = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        last = np.cumsum(n_chunks)
        size, first = np.insert(sizes[of], last, 1), np.insert(first[of], last, len(ids) - 1)
        return ids[_runs(first, size)], _sums(size, n_chunks + 1)

    def encode(self, texts: Iterable[str | None], end: int) -> Iterator[bytes]:
        """Ids of each text and the end id, as little-endian unsigned 32-bit integers."""
        ids, sizes = self.encode_column(pa.array(list(texts), pa.large_string()), end)
        for x in np.split(ids, np.cumsum(sizes)[:-1]) if len(sizes) else ():
            yield x.tobytes()


def _runs(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``first[i]``, ``first[i] + 1``, ... (``size[i]`` of them) for each ``i``, one after the other."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _sums(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums over runs of ``size[i]`` entries of ``x``."""
    sums = np.concatenate([[0], np.cumsum(x)])
    ends = np.cumsum(size)
    return sums[ends] - sums[ends - size]


@functools.lru_cache(maxsize=2)
def load(path: str) -> Tokenizer:
    return Tokenizer(path)


GROUP = "file int, first long, doc_ids array<long>, lengths array<long>, tree binary, sizes array<int>, crcs array<long>, blocks array<binary>"
_UNCODED = "file int, first long, doc_ids array<long>, lengths array<long>, tree binary, ids binary"

_LOADERS: dict[str, object] = {}     # of an application, that of the classes of ``TokenCoder.java``


def _coder(spark: SparkSession, name: str, returns: str, *columns: Column | str) -> Column:
    """The function ``name`` of ``TokenCoder.java`` on these columns.  Spark's own compiler
    compiles it once an application; executors get it as a jar."""
    sc = spark.sparkContext
    if sc.applicationId not in _LOADERS:
        compiler = sc._jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(sc._jvm.java.lang.Thread.currentThread().getContextClassLoader())
        compiler.cook(Path(__file__).with_name("TokenCoder.java").read_text(encoding="utf-8"))
        classes = compiler.getBytecodes()
        jar = os.path.join(tempfile.mkdtemp(prefix="souk-coder-"), "souk-token-coder.jar")
        with zipfile.ZipFile(jar, "w") as z:
            for c in classes:
                z.writestr(f"{c.replace('.', '/')}.class", bytes(classes[c]))
        sc._jsc.addJar(jar)
        _LOADERS[sc.applicationId] = compiler.getClassLoader()
    own = _LOADERS[sc.applicationId].loadClass(f"souk.TokenCoder${name}").newInstance()
    spark._jsparkSession.udf().register(f"souk_token_{name}", own, sc._jvm.org.apache.spark.sql.types.DataType.fromDDL(returns))
    return F.call_udf(f"souk_token_{name}", *columns)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], pa.Array]]:
    """Ids and texts of as many batches as hold ``TEXT_BYTES``."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= TEXT_BYTES:
            yield _together(held)
            held, size = [], 0
    if held:
        yield _together(held)


def _together(batches: list[pa.RecordBatch]) -> tuple[list[int | None], pa.Array]:
    return ([x for b in batches for x in b.column(0).to_pylist()],
            pa.concat_arrays([b.column(1).cast(pa.large_string()) for b in batches]))


def write(docs: DataFrame, path: str, tokenizer: str, end: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Token files of ``docs`` in ascending order of id below ``path``."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, file, first = load(tokenizer), TaskContext.get().partitionId(), 0
        ids, docs, lengths, n = [], [], [], 0

        def group() -> pa.RecordBatch:
            flat = np.concatenate(ids)
            raw = pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(np.array([0, flat.nbytes], np.int32)), pa.py_buffer(flat)])
            row = {"file": pa.array([file], pa.int32()), "first": pa.array([first], pa.int64()),
                   "doc_ids": pa.array([docs], pa.list_(pa.int64())), "lengths": pa.array([lengths], pa.list_(pa.int64())),
                   "tree": pa.array([zlib.compress(leaf_depths(flat).tobytes())], pa.binary()), "ids": raw}
            return pa.RecordBatch.from_arrays(list(row.values()), names=list(row))

        for names, texts in _gathered(batches):
            flat, sizes = tok.encode_column(texts, end)
            ends, at = np.cumsum(sizes), 0
            while at < len(sizes):
                base = ends[at] - sizes[at]
                stop = min(int(np.searchsorted(ends, base + GROUP_IDS - n)) + 1, len(sizes))
                docs += names[at:stop]
                lengths += sizes[at:stop].tolist()
                ids.append(flat[base:ends[stop - 1]])
                n, at = n + len(ids[-1]), stop
                if n >= GROUP_IDS:
                    yield group()
                    first, ids, docs, lengths, n = first + n, [], [], [], 0
        if docs:
            yield group()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # text hash and row number let the rows of one id, equal ones too, go to several files
    rows = rows.withColumns({"key": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange("id", "key", "row").sortWithinPartitions("id", "key", "row").select("id", "text")
    coded = _coder(docs.sparkSession, "Encode", "sizes array<int>, crcs array<long>, blocks array<binary>", "ids", "tree", F.lit(BLOCK))
    rows = rows.mapInArrow(run, _UNCODED).withColumn("coded", coded)
    rows.select("file", "first", "doc_ids", "lengths", "tree", "coded.*").write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files."""
    files = spark.read.schema(GROUP).parquet(path)
    totals = files.groupBy("file").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    base, bases = 0, []
    for r in totals.orderBy("file").collect():          # one row per file
        bases.append((r["file"], base))
        base += r["n"]
    bases = spark.createDataFrame(bases, "file int, base long")
    told = _coder(spark, "Told", "array<struct<doc_id: long, at: long, n_tokens: long, ids_crc32: long>>",
                  "doc_ids", "lengths", "tree", "sizes", "crcs", "blocks")
    return files.select("file", "first", F.inline(told)).join(F.broadcast(bases), "file").select(
        "doc_id", (F.col("base") + F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, ids) of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for docs, lengths, ids in zip(*b.columns):
                ends = np.cumsum([0, *lengths.as_py()])
                flat = np.frombuffer(ids.as_buffer(), np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(docs.as_py(), pa.int64()), pa.ListArray.from_arrays(
                    pa.array(ends, pa.int32()), pa.array(flat))], names=["doc_id", "ids"])
    ids = _coder(spark, "Decode", "binary", "tree", "sizes", "crcs", "blocks")
    files = spark.read.schema(GROUP).parquet(path).select("doc_ids", "lengths", ids.alias("ids"))
    return files.mapInArrow(run, "doc_id long, ids array<int>")


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer: str, end: int) -> DataFrame:
    path = shared_path(spark, "tokens")
    write(docs, path, tokenizer, end)
    return read(spark, path)
