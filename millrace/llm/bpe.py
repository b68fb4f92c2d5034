"""Byte-level BPE encoding and decoding with a compiled lexicon of the corpus' frequent words.

Spark counts the words (runs of letters) of all documents; the most frequent ones are encoded once and compiled into a
minimal acyclic transducer (``lexicon``), which every executor receives as a file and memory-maps. Tasks look words up
there and merge the others exactly, so the ids do not depend on the lexicon.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.batches import pieces
from millrace.llm.lexicon import Lexicon, compile_lexicon
from millrace.runtime import cut

LEXICON_WORDS = 32768  # words in the lexicon; bounds what the driver collects and each executor maps
COUNT_STEP = 1 / 24  # of the logarithm of a word's count: the classes among which the lexicon's last one is found
MEMO_WORDS = 400_000  # words, and as many units of text, that a task remembers until it ends
COUNTED_WORDS = 300_000  # distinct words a task holds before it hands their counts on

# The split pattern of byte-level BPE vocabularies, with Unicode's white space spelled out.
_SPACE = r"\t-\r \x85\xa0  -     　"
SPLIT = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+|"
    rf" ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    symbols = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [symbols[b] for b in range(256)]


class Codec:
    """Encoder and decoder of one vocabulary file (the JSON text of a byte-level BPE model)."""

    def __init__(self, vocabulary: str, lexicon: Lexicon | None = None, memo_words: int = MEMO_WORDS):
        spec = json.loads(vocabulary)
        vocab = spec["model"]["vocab"]
        symbols = _byte_symbols()
        value = {s: b for b, s in enumerate(symbols)}
        self.byte_ids = [vocab[s] for s in symbols]
        self.ranks: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[vocab[left], vocab[right]] = rank
            self.made.append(vocab[left + right])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max(max(vocab.values()), max(self.special.values(), default=0)) + 1
        self.token_bytes = [b""] * size
        for token, i in vocab.items():
            if token not in self.special:
                self.token_bytes[i] = bytes(value[c] for c in token)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.decimal = [str(i) for i in range(size)]
        self._split = regex.compile(SPLIT)
        self._inner = [chr(c) + " " for c in range(0x3001) if regex.fullmatch(f"[{_SPACE}]", chr(c))]
        self._special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self._lexicon = lexicon
        never = len(self.made)
        pairs = np.array([left << 32 | right for left, right in self.ranks] + [2**62], np.int64)
        order = np.argsort(pairs)
        self._pair_keys = pairs[order]
        self._pair_ranks = np.append(np.arange(never), never)[order]
        self._made = np.array([*self.made, 0], np.int64)
        self._byte_ids = np.array(self.byte_ids, np.int64)
        self._units: dict[str, bytes] = {}
        self._words: dict[str, bytes] = {}
        self._memo_words = memo_words

    def merge(self, word: bytes) -> list[int]:
        """Exact BPE of one pre-token: always the lowest-ranked pair, the leftmost first."""
        ids = [self.byte_ids[b] for b in word]
        if len(ids) > 256:
            return self._merge_long(ids)
        rank, made, never = self.ranks.get, self.made, len(self.made)
        ranks = [rank(pair, never) for pair in zip(ids, ids[1:], strict=False)]
        while ranks and (best := min(ranks)) < never:
            at = ranks.index(best)
            ids[at] = made[best]
            del ids[at + 1], ranks[at]
            if at:
                ranks[at - 1] = rank((ids[at - 1], ids[at]), never)
            if at < len(ranks):
                ranks[at] = rank((ids[at], ids[at + 1]), never)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap over a linked list: n log n for very long pre-tokens."""
        n = len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (rank := self.ranks.get((ids[i], ids[j]))) is not None:
                heapq.heappush(heap, (rank, i, ids[i], ids[j]))

        for i in range(n):
            offer(i)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j] = self.made[rank], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [x for x in ids if x >= 0]

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.searchsorted(self._pair_keys, key)
        return np.where(self._pair_keys[at] == key, self._pair_ranks[at], len(self.made))

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """Exact BPE of many non-empty pre-tokens together: each round makes the next merge of every word."""
        never = len(self.made)
        out: list[bytes] = [b""] * len(words)
        numbers = np.arange(len(words))
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ids = self._byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        starts = np.cumsum(sizes) - sizes
        ranks = np.full(len(ids), never)
        inner = np.ones(len(ids), bool)
        inner[starts + sizes - 1] = False
        at = np.flatnonzero(inner)
        ranks[at] = self._rank(ids[at], ids[at + 1])
        while len(sizes):
            best = np.minimum.reduceat(ranks << 32 | np.arange(len(ids)), starts)
            goes = best >> 32 < never
            if goes.sum() * 2 <= len(goes):  # hand out the finished words and go on with the others
                flat = ids.astype(np.uint32).tobytes()
                for k in np.flatnonzero(~goes).tolist():
                    out[numbers[k]] = flat[4 * starts[k] : 4 * (starts[k] + sizes[k])]
                stay = np.repeat(goes, sizes)
                ids, ranks, numbers, sizes = ids[stay], ranks[stay], numbers[goes], sizes[goes]
                starts = np.cumsum(sizes) - sizes
                continue
            place = best[goes] & 0xFFFFFFFF
            ids[place] = self._made[best[goes] >> 32]
            keep = np.ones(len(ids), bool)
            keep[place + 1] = False
            ranks[place] = ranks[place + 1]  # never, where the pair ended its word
            ids, ranks = ids[keep], ranks[keep]
            place = place - np.arange(len(place))
            sizes = sizes - goes
            starts = np.cumsum(sizes) - sizes
            right = place[place + 1 < (starts + sizes)[goes]]
            ranks[right] = self._rank(ids[right], ids[right + 1])
            left = place[place > starts[goes]] - 1
            ranks[left] = self._rank(ids[left], ids[left + 1])
        return out

    def _learn(self, units: set[str]) -> None:
        """Put the ids (as uint32 bytes) of new units in the memo, by the lexicon or by exact merging."""
        parts = {u: [u] if u in self.special else self._split.findall(u) for u in units}
        new = list({w for words in parts.values() for w in words if w not in self._words})
        if len(self._words) + len(new) > self._memo_words:
            self._words.clear()
            new = list({w for words in parts.values() for w in words})
        known = self._words
        encoded = [w.encode() for w in new]
        index = self._lexicon.find(encoded) if self._lexicon is not None and new else np.full(len(new), -1)
        rest = []
        for i, (word, at) in enumerate(zip(new, index.tolist(), strict=True)):
            if word in self.special:
                known[word] = np.uint32(self.special[word]).tobytes()
            elif at >= 0:
                known[word] = self._lexicon.outputs(at).tobytes()
            elif len(encoded[i]) > 256:
                known[word] = np.array(self.merge(encoded[i]), np.uint32).tobytes()
            else:
                rest.append(i)
        if rest:
            for i, ids in zip(rest, self.merge_many([encoded[i] for i in rest]), strict=True):
                known[new[i]] = ids
        for unit, words in parts.items():
            self._units[unit] = b"".join(map(known.__getitem__, words))

    def _cut(self, text: str) -> list[str]:
        """Units of a text without special tokens, whose ids do not depend on each other.

        Splitting before each blank after another character never cuts a pre-token, unless that one is white space: then
        both may be of one pre-token. Texts with such a blank, or one at their end, take the split pattern as a whole.
        """
        if not text:
            return []
        if text[-1] == " " or any(x in text for x in self._inner):
            return self._split.findall(text)
        first, *rest = text.split(" ")
        return [first, *(" " + x for x in rest)] if first else [" " + x for x in rest]

    def _units_of(self, text: str) -> list[str]:
        found = list(self._special.finditer(text)) if self._special else []
        if not found:
            return self._cut(text)
        units, at = [], 0
        for m in found:
            units += [*self._cut(text[at : m.start()]), m[0]]
            at = m.end()
        return units + self._cut(text[at:])

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids (uint32) of each text."""
        cut = [self._units_of(x) for x in texts]
        memo = self._units
        new = {u for units in cut for u in units if u not in memo}
        if len(memo) + len(new) > self._memo_words:
            memo.clear()
            new = {u for units in cut for u in units}
        self._learn(new)
        out = [np.frombuffer(b"".join(map(memo.__getitem__, units)), np.uint32) for units in cut]
        for held in (memo, self._words):
            for u in [u for u in held if len(u) > 200] if any(len(u) > 200 for u in new) else ():
                del held[u]
        return out

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text (uint32)."""
        return self.encode_many([text])[0]

    def decode(self, ids) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


_LETTERS = re.compile(r"[^\W\d_]+")


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[str] = Counter()

    def handed_on():
        out = pa.record_batch({"word": pa.array(counts.keys(), pa.string()), "n": pa.array(counts.values(), pa.int64())})
        counts.clear()
        return out

    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text:
                counts.update(_LETTERS.findall(text))
            if len(counts) >= COUNTED_WORDS:
                yield handed_on()
    if counts:
        yield handed_on()


def frequent_words(docs: DataFrame, text: str = "text", words: int = LEXICON_WORDS) -> list[str]:
    """At most ``words`` of the most frequent runs of letters in all documents, of those that occur more than once.

    A histogram of the counts (some hundred rows at most) tells from which class of counts on the words are few enough;
    only those are collected. A class that does not fit whole stays out, so ties need no order.
    """
    counted = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(_count_words, "word string, n long")
    total = counted.groupBy("word").agg(F.sum("n").alias("n")).where("word != '' and n > 1")
    total = cut(total.select("word", F.floor(F.log("n") / COUNT_STEP).cast("int").alias("class")))
    lowest, held = None, 0
    for r in sorted(total.groupBy("class").count().collect(), key=lambda r: -r["class"]):
        held += r["count"]
        if held > words:
            break
        lowest = r["class"]
    if lowest is None:
        return []
    return sorted(r.word for r in total.where(F.col("class") >= lowest).select("word").collect())


def compile_words(vocabulary: str, words: list[str]) -> bytes:
    """The transducer of the words, each after a blank."""
    codec = Codec(vocabulary)
    spaced = [f" {w}" for w in words]
    return compile_lexicon((w.encode(), ids.tolist()) for w, ids in zip(spaced, codec.encode_many(spaced), strict=True))


def _codec(vocabulary: str, lexicon_file: str) -> Codec:
    """A codec for one task. Workers outlive their tasks, so nothing keeps it (and what it remembers) beyond that."""
    return Codec(vocabulary, Lexicon.open(SparkFiles.get(lexicon_file)))


def _share(docs: DataFrame, text: str, tokenizer_path: str, lexicon_words: int):
    """The vocabulary as a broadcast, and the name of the lexicon file that executors get."""
    with open(tokenizer_path, encoding="utf-8") as f:
        vocabulary = f.read()
    sc = docs.sparkSession.sparkContext
    compiled = compile_words(vocabulary, frequent_words(docs, text, lexicon_words))
    name = f"lexicon-{hashlib.sha256(compiled).hexdigest()[:24]}.bin"
    path = os.path.join(SparkFiles.getRootDirectory(), name)  # the driver's own folder, gone with the session
    if not os.path.exists(path):
        with open(path, "wb") as f:
            f.write(compiled)
    sc.addFile(path)  # Spark's file server hands it to the executors
    return sc.broadcast(vocabulary), name


def encode_documents(
    docs: DataFrame,
    tokenizer_path: str,
    doc_id: str = "doc_id",
    text: str = "text",
    lexicon_words: int = LEXICON_WORDS,
) -> DataFrame:
    """doc_id, n_tokens, ids (array of int) of every whole text; null counts as empty, other columns are ignored.

    ``tokenizer_path`` is a byte-level BPE vocabulary in the JSON format of the tokenizers library. The ids equal that
    library's ``encode(text, add_special_tokens=False)``: strings of special tokens in a text become their ids.
    """
    vocabulary, name = _share(docs, text, tokenizer_path, lexicon_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary.value, name)
        for batch in batches:
            for piece in pieces(batch, 1):
                ids = codec.encode_many([x or "" for x in piece.column(1).to_pylist()])
                sizes = np.fromiter(map(len, ids), np.int64, len(ids))
                values = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield pa.record_batch(
                    {
                        "doc_id": piece.column(0),
                        "n_tokens": pa.array(sizes),
                        "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)),
                    }
                )

    kind = docs.schema[doc_id].dataType.simpleString()
    return _two(docs, doc_id, text).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids array<int>")


def decode_documents(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, text of (doc_id, ids) rows; null ids give an empty text."""
    with open(tokenizer_path, encoding="utf-8") as f:
        vocabulary = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(vocabulary.value)
        for batch in batches:
            texts = [codec.decode(x or ()) for x in batch.column(1).to_pylist()]
            yield pa.record_batch({"doc_id": batch.column(0), "text": pa.array(texts, pa.string())})

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def round_trip_digests(
    docs: DataFrame,
    tokenizer_path: str,
    doc_id: str = "doc_id",
    text: str = "text",
    lexicon_words: int = LEXICON_WORDS,
) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text is encoded, and its ids are decoded, in one task.

    The first digest is of the decimal ids joined by commas, the second of the decoded text in UTF-8. Nulls, empty
    texts and repeated rows as in ``encode_documents``: one row a row.
    """
    vocabulary, name = _share(docs, text, tokenizer_path, lexicon_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary.value, name)
        sha = hashlib.sha256
        for batch in batches:
            for piece in pieces(batch, 1):
                n, coded, decoded = [], [], []
                for ids in codec.encode_many([x or "" for x in piece.column(1).to_pylist()]):
                    ids = ids.tolist()
                    n.append(len(ids))
                    coded.append(sha(",".join(map(codec.decimal.__getitem__, ids)).encode()).hexdigest())
                    decoded.append(sha(codec.decode(ids).encode()).hexdigest())
                yield pa.record_batch(
                    {
                        "doc_id": piece.column(0),
                        "n_tokens": pa.array(n, pa.int64()),
                        "ids_sha256": pa.array(coded, pa.string()),
                        "decoded_sha256": pa.array(decoded, pa.string()),
                    }
                )

    kind = docs.schema[doc_id].dataType.simpleString()
    return _two(docs, doc_id, text).mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def _two(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))

