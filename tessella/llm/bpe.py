"""Byte-level BPE: encoding by a traversal of a trie of distinct words, and decoding.

An encoding of a text ends in one token, and that token alone says how the text
before it is encoded.  So a trie node needs to hold just the *last token* of
its prefix: it is the one token that ends the prefix and may stand after the
last token of what is left.  A depth-first traversal computes this once for
each prefix that words share.  Walking through sorted distinct words visits the
trie in that order with one root-to-node path in memory.

Which token may follow which is decided from the merges: two tokens can stand
side by side unless, at some moment of the merging, the piece at the right edge
of the first and the piece at the left edge of the second would have merged.

Edge cases: a null text counts as empty and has no tokens; a null doc_id is
returned as it is; the special token's own string in a text becomes its id.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from tessella.llm.common import arrow_map, arrow_slices, table, texts

VOCABULARY = "byte_bpe_50k.json"
#: How a byte-level tokenizer cuts text into words before merging (a fixed public pattern).
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: White space before a blank: only there does a cut at each blank differ from the pattern.
_BLANK_RUN = re.compile(r"\s ")
#: Most entries of a worker's cache of encoded pieces; beyond, it starts anew.
CACHE = 600_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class BytePairs:
    """A byte-level BPE vocabulary that encodes many words at a time."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        as_bytes = lambda s: bytes(alphabet[c] for c in s)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocabulary = {s: i for s, i in spec["model"]["vocab"].items() if s not in self.special}
        size = max([*vocabulary.values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        self.id_of: dict[bytes, int] = {}
        for s, i in vocabulary.items():
            self.bytes_of[i] = as_bytes(s)
            self.id_of[self.bytes_of[i]] = i
        for s, i in self.special.items():
            self.bytes_of[i] = s.encode()
        self.rank: dict[tuple[int, int], int] = {}
        born = [-1] * size
        parts: list[tuple[int, int] | None] = [None] * size
        for r, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            a, b = vocabulary[left], vocabulary[right]
            made = vocabulary[left + right]
            self.rank[a, b] = r
            if parts[made] is None:
                born[made], parts[made] = r, (a, b)
        # The tokens read backwards, as one transition table: (node, byte) -> node, and the token that a node ends.
        self._step: dict[int, int] = {}
        self._ends: list[int] = [-1]
        for word, t in self.id_of.items():
            at = 0
            for byte in reversed(word):
                key = at << 8 | byte
                if key not in self._step:
                    self._step[key] = len(self._ends)
                    self._ends.append(-1)
                at = self._step[key]
            self._ends[at] = t
        never = len(self.rank)
        self._right_edge: list[list[tuple[int, int, int]]] = []
        self._left_edge: list[list[tuple[int, int, int]]] = []
        for side, out in ((1, self._right_edge), (0, self._left_edge)):
            for t in range(size):
                chain, until, at = [], never, t
                while True:  # piece, when it is made, when it goes into a larger one
                    chain.append((at, born[at], until))
                    if parts[at] is None:
                        break
                    until, at = born[at], parts[at][side]
                out.append(chain)
        self._may: dict[int, bool] = {}
        self._whole: dict[int, bool] = {}
        self._size = size

    def may_follow(self, a: int, b: int) -> bool:
        """Whether token b can stand right after token a."""
        key = a * self._size + b
        found = self._may.get(key)
        if found is None:
            found = True
            for x, made_x, until_x in self._right_edge[a]:
                for y, made_y, until_y in self._left_edge[b]:
                    r = self.rank.get((x, y))
                    # Merges of one rank go from left to right: inside a first, then here, then inside b.
                    if r is not None and made_x < r < until_x and made_y < r <= until_y:
                        found = False
            self._may[key] = found
        return found

    def _is_own_encoding(self, t: int) -> bool:
        found = self._whole.get(t)
        if found is None:
            found = self._whole[t] = self.merge(self.bytes_of[t]) == [t]
        return found

    def merge(self, word: bytes) -> list[int]:
        """Plain BPE, merge by merge; the reference for the traversal."""
        ids = [self.id_of[bytes([b])] for b in word]
        while len(ids) > 1:
            best = min(range(len(ids) - 1), key=lambda i: self.rank.get((ids[i], ids[i + 1]), len(self.rank)))
            pair = (ids[best], ids[best + 1])
            if pair not in self.rank:
                break
            ids[best : best + 2] = [self.id_of[self.bytes_of[pair[0]] + self.bytes_of[pair[1]]]]
        return ids

    def encode_words(self, words: list[bytes]) -> dict[bytes, bytes]:
        """word -> its ids as little-endian 16-bit numbers, for distinct words."""
        out: dict[bytes, bytes] = {}
        last: list[int] = [0]  # last[i]: the last token of the path's first i bytes
        step, ends, size = self._step.get, self._ends, self._size
        may, may_follow, whole = self._may.get, self.may_follow, self._is_own_encoding
        before = b""
        for word in sorted(words):
            n, shared = len(word), 0
            for x, y in zip(before, word, strict=False):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :]
            for end in range(shared + 1, n + 1):
                found, node, start = [], 0, end
                while start:
                    node = step(node << 8 | word[start - 1])
                    if node is None:
                        break
                    start -= 1
                    if ends[node] >= 0:
                        found.append((start, ends[node]))
                for start, t in reversed(found):
                    if start:
                        ok = may(last[start] * size + t)
                        if ok is None:
                            ok = may_follow(last[start], t)
                    else:
                        ok = whole(t)
                    if ok:
                        last.append(t)
                        break
                else:
                    raise ValueError(f"no token ends {word[:end]!r}")
            ids, at = [], n
            while at:
                ids.append(last[at])
                at -= len(self.bytes_of[last[at]])
            out[word] = np.array(ids[::-1], dtype="<u2").tobytes()
            before = word
        return out


class Encoder:
    """Whole texts, with a bounded cache of pieces that were seen before."""

    def __init__(self, path: str, cache: int = CACHE):
        self.pairs = BytePairs(path)
        if len(self.pairs.bytes_of) > 1 << 16:
            raise ValueError("ids must fit in 16 bits")
        self.head: dict[str, bytes] = {}  # pieces as they are
        self.tail: dict[str, bytes] = {}  # pieces after a blank that belongs to them
        self.words: dict[bytes, bytes] = {}
        self.most = cache
        self.special = re.compile("(" + "|".join(map(re.escape, self.pairs.special)) + ")") if self.pairs.special else None

    def pieces(self, text: str) -> tuple[list[str], list[str]]:
        """Pieces whose encodings don't depend on their neighbours: those without and those with a blank before."""
        if not text:
            return [], []
        if self.special is not None and self.special.search(text):
            return [w for i, x in enumerate(self.special.split(text)) for w in ([x] if i % 2 else WORDS.findall(x))], []
        if _BLANK_RUN.search(text):
            return WORDS.findall(text), []
        first, *rest = text.split(" ")
        return [first] if first else [], rest

    def learn(self, head: set[str], tail: set[str]) -> None:
        """Encodes what the cache lacks: one trie for all new words."""
        if len(self.words) > self.most:
            self.words.clear()
        cut = [(known, p, [w.encode() for w in WORDS.findall(before + p)]) for known, before, new in ((self.head, "", head), (self.tail, " ", tail)) for p in new]
        self.words |= self.pairs.encode_words(list({w for _, _, ws in cut for w in ws if w not in self.words}))
        words = self.words
        for known, p, ws in cut:
            known[p] = b"".join([words[w] for w in ws])

    def encode(self, column: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian 16-bit numbers."""
        cut = [self.pieces(text or "") for text in column]
        head, tail = set().union(*(h for h, _ in cut)), set().union(*(t for _, t in cut))
        if len(self.head) + len(head) > self.most:
            self.head.clear()
        if len(self.tail) + len(tail) > self.most:
            self.tail.clear()
        for s, i in self.pairs.special.items():
            self.head[s] = np.array([i], dtype="<u2").tobytes()
        head.difference_update(self.head)
        tail.difference_update(self.tail)
        if head or tail:
            self.learn(head, tail)
        first, rest = self.head.__getitem__, self.tail.__getitem__
        return [b"".join(map(first, h)) + b"".join(map(rest, t)) for h, t in cut]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a text from its ids."""
        return b"".join(map(self.pairs.bytes_of.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path)


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def digests(docs: DataFrame, name: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of whole texts."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        known = encoder(vocabulary_path(name))
        for part, _, _ in arrow_slices(batch):
            n, ids_sha, text_sha = [], [], []
            for ids in known.encode(part.column(1).to_pylist()):
                ids = np.frombuffer(ids, dtype="<u2")
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(known.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return arrow_map(texts(docs), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, name: str = VOCABULARY) -> DataFrame:
    """doc_id, ids: the general form, with the ids themselves."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        known = encoder(vocabulary_path(name))
        for part, _, _ in arrow_slices(batch):
            ids = [np.frombuffer(x, dtype="<u2").astype(np.int32) for x in known.encode(part.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return arrow_map(texts(docs), run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, name: str = VOCABULARY) -> DataFrame:
    """doc_id, text of (doc_id, ids); null ids are an empty text."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        known = encoder(vocabulary_path(name))
        out = [known.decode(np.array(x or [], dtype=np.int64)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return arrow_map(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1_bpe over all of ``documents``."""
    return digests(table(spark, sf_dir, "documents"))
