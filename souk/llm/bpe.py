"""Byte-level byte-pair encoding by speculation and verification.

A text is cut into words (pre-tokens).  For each word not seen before a greedy
longest match proposes tokens.  A sequence of tokens is the encoding of its bytes
exactly when every adjacent pair is compatible, that is, when byte-pair merging
never joins across the boundary; all pairs of a batch are tested at once by
vectorised unwinding of their merges.  Words with an incompatible pair undergo
exact merging (a heap over neighbouring pairs, so long words stay cheap).

The vocabulary is a ``tokenizers`` JSON file whose path is a parameter: a BPE
model with a byte-level pre-tokenizer and decoder, no normaliser.  Each Python
worker loads it once and keeps a bounded cache of encoded chunks.

Defined cases: null and empty texts have no tokens and decode to the empty text;
the strings of added tokens in a text become their ids, as in the library; texts
of any length are encoded whole, in groups of bounded size; repeated rows are
encoded alike; empty tables give an empty result; unknown ids fail to decode.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import json
import re
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers.pre_tokenizers import ByteLevel

from souk.llm.common import give_back, small_batches

CACHE_CHUNKS = 150_000
ROWS = 512              # rows of a batch that are encoded at a time
SHORT = 32              # bytes of a word that is merged together with others
TOGETHER = 50_000       # such words at a time
GROUP_CHARS = 2_000_000
# fixed value: the byte-level pre-tokenizer's pattern
WORDS = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
         r"|\p{White_Space}+(?![^\p{White_Space}])|\p{White_Space}+")
_WORDS = regex.compile(WORDS)
_BETWEEN = "\u0100"
# from here on Unicode versions differ in what they call a letter: the library's own pre-tokenizer cuts such chunks
_LATE = re.compile("[\u0860-\U0010ffff]")
_LIBRARY = ByteLevel(add_prefix_space=False, use_regex=True)
_SPACES = re.compile(r"\s | \s")
_BEFORE_WORD = re.compile(r"(?<=\S)(?= \S)")


def byte_alphabet() -> dict[str, int]:
    """Printable Latin-1 characters stand for themselves, the other bytes for U+0100 upwards."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def words_of(chunk: str) -> list[str]:
    if _LATE.search(chunk):
        return [chunk[a:b] for _, (a, b) in _LIBRARY.pre_tokenize_str(chunk)]
    return _WORDS.findall(chunk)


class Bpe:
    """Tokens are numbered by formation: 0-255 single bytes, then one per merge."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model, kinds = spec["model"], [spec[k] and spec[k]["type"] for k in ("normalizer", "pre_tokenizer", "decoder")]
        if model["type"] != "BPE" or kinds != [None, "ByteLevel", "ByteLevel"] or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("a byte-level BPE file without normalizer or prefix space is needed")
        alphabet = byte_alphabet()
        raw = lambda token: bytes(alphabet[c] for c in token)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        number = {bytes([b]): b for b in range(256)}
        self.bytes: list[bytes] = [bytes([b]) for b in range(256)]
        left, right = list(range(256)), list(range(256))
        for a, b in merges:
            a, b = raw(a), raw(b)
            if a + b in number:
                raise ValueError("two merges form the same token")
            number[a + b] = len(self.bytes)
            left.append(number[a])
            right.append(number[b])
            self.bytes.append(a + b)
        self.left, self.right = np.array(left), np.array(right)
        n = self.n = len(self.bytes)
        vocab = {raw(t): i for t, i in model["vocab"].items()}
        self.ids = np.array([vocab[t] for t in self.bytes], dtype=np.uint32)
        self._table(self.left[256:] * (n + 1) + self.right[256:])
        self.merge_of = {(a, b): i + 256 for i, (a, b) in enumerate(zip(left[256:], right[256:]))}
        # a token is proposed only if merging its own bytes forms it
        fits = np.ones(n, bool)
        fits[256:] = self.compatible(self.left[256:], self.right[256:], forming=True)
        ok = fits.tolist()
        for t in range(256, n):
            ok[t] = ok[t] and ok[left[t]] and ok[right[t]]
        self.size = np.array([len(b) for b in self.bytes])
        self.proposed = np.flatnonzero(ok)
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that strip or need whole words are not supported")
        self.added = {k: np.array([i], np.uint32).tobytes() for k, i in added.items()}
        self._added = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.cache: dict[str, bytes] = {}

    @functools.cached_property
    def matcher(self) -> ahocorasick.Automaton:
        """Finds leftmost-longest tokens; only encoding needs it."""
        found = ahocorasick.Automaton()
        for t in self.proposed.tolist():
            found.add_word(self.bytes[t].decode("latin-1"), t)
        found.make_automaton()
        return found

    def _table(self, keys: np.ndarray) -> None:
        """Open addressing over pair keys, a quarter full at most."""
        size = 1 << (4 * len(keys)).bit_length()
        self._key, self._merged = np.full(size, -1, np.int64), np.full(size, self.n, np.int64)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            spot = at[left] % size
            free = self._key[spot] == -1
            spot, put = np.unique(spot[free], return_index=True)
            put = left[free][put]
            self._key[spot], self._merged[spot] = keys[put], put + 256
            left = np.setdiff1d(left, put, assume_unique=True)
            at[left] += 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        mixed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - (len(self._key) - 1).bit_length())).astype(np.int64)

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token that a pair merges into, or n if none (n also stands for no token)."""
        key = a * (self.n + 1) + b
        at = self._slot(key)
        found = self._key[at]
        out = np.where(found == key, self._merged[at], self.n)
        live = np.flatnonzero((found != key) & (found != -1))
        while len(live):
            at[live] = (at[live] + 1) & (len(self._key) - 1)
            found = self._key[at[live]]
            hit = found == key[live]
            out[live[hit]] = self._merged[at[live[hit]]]
            live = live[~hit & (found != -1)]
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray, forming: bool = False) -> np.ndarray:
        """Whether merging never joins across the boundary of each pair.

        Goes back through the two tokens' merges, latest first: a pair of edge
        tokens joins if its merge ranks before the one that consumed an edge.
        Of equal merges the left one happened first.  ``forming``: the pair's
        own merge, which forms a token, is not held against it."""
        a, b = a.copy(), b.copy()
        good = np.ones(len(a), bool)
        live = np.arange(len(a))
        limit = np.full(len(a), self.n)
        first = forming
        while len(live):
            x, y = a[live], b[live]
            joins = self.merged(x, y) < limit[live] if not first else np.zeros(len(live), bool)
            first = False
            good[live[joins]] = False
            undo_left = ((x > y) & (x >= 256)) | (y < 256)
            more = ~joins & ((x >= 256) | (y >= 256))
            lft, rgt = live[more & undo_left], live[more & ~undo_left]
            limit[lft] = a[lft]
            a[lft] = self.right[a[lft]]
            limit[rgt] = b[rgt] + 1
            b[rgt] = self.left[b[rgt]]
            live = live[more]
        return good

    def propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest matches of all words: tokens, and the word of each."""
        ends = np.cumsum(np.fromiter((len(w) + 1 for w in words), np.int64, len(words)))
        # the bytes as characters; one that is no byte, so never part of a token, between words
        text = _BETWEEN.join([w.decode("latin-1") for w in words])
        found = np.fromiter(itertools.chain.from_iterable(self.matcher.iter_long(text)), np.int64)
        return found[1::2], np.searchsorted(ends, found[::2], side="right")

    def merge(self, word: bytes) -> list[int]:
        """Exact byte-pair merging: lowest merge first, of equal ones the leftmost."""
        tokens: list[int] = list(word)
        after, before = list(range(1, len(tokens) + 1)), list(range(-1, len(tokens) - 1))
        heap = [(m, i) for i in range(len(tokens) - 1) if (m := self.merge_of.get((tokens[i], tokens[i + 1]))) is not None]
        heapq.heapify(heap)
        end = len(tokens)
        while heap:
            m, i = heapq.heappop(heap)
            j = after[i]
            if tokens[i] < 0 or j >= end or self.merge_of.get((tokens[i], tokens[j])) != m:
                continue
            tokens[i], tokens[j] = m, -1
            after[i] = after[j]
            if after[i] < end:
                before[after[i]] = i
                if (x := self.merge_of.get((m, tokens[after[i]]))) is not None:
                    heapq.heappush(heap, (x, i))
            if before[i] >= 0 and (x := self.merge_of.get((tokens[before[i]], m))) is not None:
                heapq.heappush(heap, (x, before[i]))
        return [t for t in tokens if t >= 0]

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """Exact merging of many short words in step: each round every word merges
        its lowest pair, of equal ones the leftmost."""
        out = [b""] * len(words)
        width = max(map(len, words))
        rows = np.arange(len(words))
        size = np.fromiter(map(len, words), np.int64, len(words))
        tokens = np.full((len(words), width), self.n, np.int64)
        tokens[np.arange(width) < size[:, None]] = np.frombuffer(b"".join(words), np.uint8)
        pairs = self.merged(tokens[:, :-1].ravel(), tokens[:, 1:].ravel()).reshape(len(words), width - 1)
        while len(rows):
            col = pairs.argmin(axis=1) if pairs.shape[1] else np.zeros(len(rows), np.int64)
            best = pairs[np.arange(len(rows)), col] if pairs.shape[1] else np.full(len(rows), self.n)
            over = best == self.n
            held = tokens[over] != self.n
            for i, x in zip(rows[over].tolist(), self._cut(tokens[over][held], held.sum(axis=1))):
                out[i] = x
            live = ~over
            rows, col, best, tokens, pairs = rows[live], col[live], best[live], tokens[live], pairs[live]
            if not len(rows):
                break
            every, width = np.arange(len(rows)), tokens.shape[1]
            tokens[every, col] = best
            tokens = tokens[np.arange(width) != col[:, None] + 1].reshape(len(rows), width - 1)
            pairs = pairs[np.arange(width - 1) != col[:, None]].reshape(len(rows), width - 2)
            for side in (col - 1, col):
                at = np.flatnonzero((side >= 0) & (side < width - 2))
                x = side[at]
                pairs[at, x] = self.merged(tokens[at, x], tokens[at, x + 1])
        return out

    def _cut(self, tokens: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """Ids of consecutive words, each as little-endian unsigned 32-bit integers."""
        blob, ends = self.ids[tokens].tobytes(), (4 * np.cumsum(sizes)).tolist()
        return [blob[a:b] for a, b in zip([0, *ends], ends)]

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Each word's ids as little-endian unsigned 32-bit integers."""
        flat, word = self.propose(words)
        out = self._cut(flat, np.bincount(word, minlength=len(words)))
        inner = np.flatnonzero(word[1:] == word[:-1])
        pair, where = np.unique(flat[inner] * self.n + flat[inner + 1], return_inverse=True)
        bad = ~self.compatible(pair // self.n, pair % self.n)[where]
        failed = np.zeros(len(words), bool)
        failed[word[inner[bad]]] = True
        # a proposal that does not cover its word would not be an encoding of it
        covered = np.bincount(word, weights=self.size[flat], minlength=len(words))
        failed |= covered != np.fromiter(map(len, words), np.int64, len(words))
        failed = np.flatnonzero(failed).tolist()
        short = sorted((i for i in failed if len(words[i]) <= SHORT), key=lambda i: len(words[i]))
        for lo in range(0, len(short), TOGETHER):
            part = short[lo:lo + TOGETHER]
            for i, x in zip(part, self.merge_many([words[i] for i in part])):
                out[i] = x
        for i in failed:
            if len(words[i]) > SHORT:
                out[i] = self.ids[self.merge(words[i])].tobytes()
        return out

    def _learn(self, chunks: list[str]) -> None:
        """Encodes chunks that are not in the cache."""
        parts = [words_of(c) for c in chunks]
        distinct = {w: i for i, w in enumerate({w for p in parts for w in p})}
        done = self.encode_words([w.encode() for w in distinct])
        for c, p in zip(chunks, parts):
            self.cache[c] = b"".join([done[distinct[w]] for w in p])

    def _chunks(self, text: str) -> list[str]:
        """Cuts before single spaces between words, where a word always starts."""
        if _SPACES.search(text):
            return _BEFORE_WORD.split(text)
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]]

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        group, chars = [], 0
        for t in texts:
            t = t or ""
            plain = [t] if self._added is None else self._added.split(t)
            group.append([(p, None) if i % 2 else (None, self._chunks(p)) for i, p in enumerate(plain)])
            chars += len(t)
            if chars > GROUP_CHARS:
                yield from self._encode(group)
                group, chars = [], 0
        yield from self._encode(group)

    def _encode(self, group: list) -> Iterator[bytes]:
        if len(self.cache) > CACHE_CHUNKS:
            self.cache.clear()
        wanted = set().union(*(c for text in group for _, c in text if c is not None))
        if new := list(wanted - self.cache.keys()):
            self._learn(new)
        look = self.cache.__getitem__
        for text in group:
            yield b"".join([self.added[a] if c is None else b"".join(map(look, c)) for a, c in text])


@functools.lru_cache(maxsize=2)
def token_bytes(path: str) -> list[bytes | None]:
    """What each id stands for; all that decoding needs."""
    spec, alphabet = json.load(open(path, encoding="utf-8")), byte_alphabet()
    of = {i: bytes(alphabet[c] for c in t) for t, i in spec["model"]["vocab"].items()}
    of |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
    return [of.get(i) for i in range(max(of) + 1)]


def decode_ids(ids: np.ndarray, tokens: list[bytes | None]) -> str:
    return b"".join(map(tokens.__getitem__, ids.tolist())).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(id, ids) of every row; ids: array<int>.  ``decoded`` adds the text that the
    ids decode to, in the same pass (one Python worker a task instead of two)."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, tokens = load(path), token_bytes(path) if decoded else []
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):
                b = whole.slice(lo, ROWS)
                found = list(bpe.encode(b.column(1).to_pylist()))
                ends = np.cumsum([0] + [len(x) // 4 for x in found])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), np.int32)))
                texts = [pa.array([decode_ids(np.frombuffer(x, np.int32), tokens) for x in found], pa.string())] if decoded else []
                yield pa.RecordBatch.from_arrays([b.column(0), ids, *texts], names=["id", "ids", "text"][:2 + decoded])
        bpe.cache.clear()
        give_back()

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"id {kind.simpleString()}, ids array<int>" + ", text string" * decoded)
    return out.withColumnsRenamed({"id": id_col, "text": text_col})


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``encoded`` with the decoded text added (in place of a column of that name)."""
    small_batches(encoded.sparkSession)
    plain = encoded.drop(text_col)
    at = plain.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = token_bytes(path)
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):
                b = whole.slice(lo, ROWS)
                ids = b.column(at)
                ends, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
                # a null list spans nothing and decodes to the empty text
                texts = [decode_ids(flat[x:y], tokens) for x, y in itertools.pairwise(ends.tolist())]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, text_col])

    return plain.mapInArrow(run, T.StructType([*plain.schema.fields, T.StructField(text_col, T.StringType())]))
