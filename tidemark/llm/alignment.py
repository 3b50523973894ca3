"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes of a document.

A document is ``space + text``. Vocabulary A (byte-level BPE) encodes it as it stands; vocabulary B (sentencepiece,
which puts the space itself) encodes the text. Byte offsets where a token of A and a token of B both end are cuts;
what lies between two cuts is a group, and every token of A in a group is linked to every token of B in it.

1. **Lockstep merging.** All documents of a batch advance together: one vector holds each document's place in A, one
   its place in B. A step compares the ends of all current tokens at once; the side that ends first moves on, where
   both end together a group is emitted (its cut and its block of links) and both move on. Finished documents are
   taken out of the vectors. Documents of more than ``LANE`` tokens enter as several lanes, parted at shared ends, so a
   very long text does not run alone at the end.
2. **Counts.** Documents are put into blocks by their task. A block writes its distinct pairs of ids with the number of
   its documents that hold them, and per document the places of its pairs in that list. The pair rows are added up over
   the corpus and compared with the highest of their A id (a group of at most the size of vocabulary B).
3. **Answers.** Each block gets the totals of its own pairs back, and adds them up over its documents. No pair's
   documents ever meet in one task: a pair has one row per block, however many documents hold it.

Texts that are null or empty, and texts whose tokens of A or B don't spell ``space + text`` byte for byte (for
instance with U+2581, which B reads as a space), have no tokens: zeros and an empty string for the groups. Special
strings inside texts are plain text. Repeated rows and repeated or null doc ids stay rows of their own and count as
documents of their own. A long text is handled whole, alone in its batch. An empty table gives no rows. Of other columns
nothing is read or returned.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm.bpe_trie import BYTE_LEVEL_PATTERN, UNSTABLE, byte_alphabet
from tidemark.llm.common import shipped, slices, texts_of
from tidemark.sources.scratch import staged

# Tokens of A after which a long document is parted into another lane, and the shared ends looked for behind that place.
LANE, LOOK = 1024, 32
# Text and documents of a block.
BLOCK_BYTES, BLOCK_DOCS = 16_000_000, 30_000
# Links expanded at once; a group with more of them goes through its distinct ids.
WIDE = 1 << 12
CHUNK = 1 << 21
PAIR_BITS = 40  # of a key (document, pair)
STAGED = (
    "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, payload binary, "
    "pair long, place long, n_docs long"
)
RESULT = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
)


class Vocabularies:
    """Ids of both vocabularies and the bytes of each token."""

    def __init__(self, path_a: str, path_b: str):
        self.path_a = path_a
        spec = json.load(open(path_a, encoding="utf-8"))
        back = {c: b for b, c in enumerate(byte_alphabet())}
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(back[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.ranks = tiktoken.Encoding("alignment", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_a = [b""] * (max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        for t, i in ranks.items():
            self.bytes_a[i] = t
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path_b)
        names = (self.pieces.id_to_piece(i) for i in range(len(self.pieces)))
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.pieces.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)
        ]
        self.sizes_a, self.sizes_b = (np.array([len(t) for t in table], np.int64) for table in (self.bytes_a, self.bytes_b))
        if len(self.bytes_a) * len(self.bytes_b) >= 1 << PAIR_BITS:
            raise ValueError("the vocabularies are too large for the keys of pairs")
        self._library = None

    @property
    def library(self) -> Tokenizer:
        """The vocabulary's own library, for texts whose characters Unicode versions see differently."""
        if self._library is None:
            self._library = Tokenizer.from_file(self.path_a)
            self._library.no_truncation()
            self._library.no_padding()
            self._library.encode_special_tokens = True
        return self._library

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of A and of B for each text; none where they don't spell ``space + text``."""
        out_a, out_b, none = [], [], np.zeros(0, np.int64)
        for text, found in zip(texts, self.pieces.encode(texts, num_threads=1)):
            a = b = none
            if text:
                spaced = " " + text
                raw = spaced.encode("utf-8", "surrogatepass")
                if UNSTABLE.search(text):
                    a = np.array(self.library.encode(spaced, add_special_tokens=False).ids, np.int64)
                else:
                    a = self.ranks.encode_to_numpy(spaced, disallowed_special=()).astype(np.int64)
                b = np.array(found, np.int64)
                if b"".join(map(self.bytes_b.__getitem__, found)) != raw or b"".join(map(self.bytes_a.__getitem__, a.tolist())) != raw:
                    a = b = none
            out_a.append(a)
            out_b.append(b)
        return out_a, out_b


@lru_cache(maxsize=2)
def vocabularies(path_a: str, path_b: str) -> Vocabularies:
    return Vocabularies(path_a, path_b)


def lanes(ends_a: np.ndarray, ends_b: np.ndarray, doc_stops: np.ndarray, lane: int) -> tuple[np.ndarray, np.ndarray]:
    """Stops (places in A and in B after the last token) of the lanes: ends of documents, and shared ends inside long ones."""
    sizes = np.diff(doc_stops, prepend=0)
    every = np.concatenate([np.arange(stop - size + lane, stop, lane) for stop, size in zip(doc_stops, sizes) if size > lane] or [np.zeros(0, np.int64)])
    if len(every):
        near = np.minimum(every[:, None] + np.arange(LOOK), len(ends_a) - 1)
        there = np.minimum(np.searchsorted(ends_b, ends_a[near]), len(ends_b) - 1)
        shared = ends_b[there] == ends_a[near]
        found = shared.any(axis=1)
        every = near[found, shared[found].argmax(axis=1)] + 1
    stops_a = np.unique(np.concatenate([doc_stops, every]))
    stops_a = stops_a[stops_a > 0]
    return stops_a, np.searchsorted(ends_b, ends_a[stops_a - 1]) + 1


def merge(ends_a: np.ndarray, ends_b: np.ndarray, stops_a: np.ndarray, stops_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lockstep walk of all lanes: the groups' stops in A and in B, in order."""
    at_a, at_b = np.concatenate([[0], stops_a])[:-1], np.concatenate([[0], stops_b])[:-1]
    left = stops_a.copy()
    cuts_a, cuts_b = [], []
    while len(at_a):
        end_a, end_b = ends_a[at_a], ends_b[at_b]
        at_a, at_b = at_a + (end_a <= end_b), at_b + (end_b <= end_a)
        both = end_a == end_b
        cuts_a.append(at_a[both])
        cuts_b.append(at_b[both])
        going = at_a < left
        if not going.all():
            at_a, at_b, left = at_a[going], at_b[going], left[going]
    if not cuts_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cuts = np.sort(np.concatenate(cuts_a) << 32 | np.concatenate(cuts_b))
    return cuts >> 32, cuts & 0xFFFFFFFF


def spelled(ids: np.ndarray, after: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Decimal ids, each followed by its sign, as one run of bytes; and where each id's part stops."""
    top = int(ids.max()) if len(ids) else 0
    width = len(str(top))
    numbers = np.arange(top + 1)
    digits = np.full((top + 1, width), 0, np.uint8)
    used = np.ones(top + 1, np.int64)
    for w in range(1, width):
        used[10**w :] = w + 1
    for w in range(width):
        place = used - 1 - w
        has = place >= 0
        digits[has, w] = numbers[has] // 10 ** place[has] % 10 + ord("0")
    size = used[ids]
    cells = np.zeros((len(ids), width + 1), np.uint8)
    cells[:, :width] = digits[ids]
    cells[np.arange(len(ids)), size] = after
    return cells[np.arange(width + 1) <= size[:, None]].tobytes(), np.cumsum(size + 1)


class Aligned:
    """A batch of documents aligned: groups, links and their digests."""

    def __init__(self, ids_a: list[np.ndarray], ids_b: list[np.ndarray], vocab: Vocabularies, lane: int = LANE):
        self.n_a, self.n_b = (np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b))
        self.a, self.b = (np.concatenate([*ids, np.zeros(0, np.int64)]) for ids in (ids_a, ids_b))
        stops_a = np.cumsum(self.n_a)
        ends_a, ends_b = np.cumsum(vocab.sizes_a[self.a]), np.cumsum(vocab.sizes_b[self.b])
        self.stop_a, self.stop_b = merge(ends_a, ends_b, *lanes(ends_a, ends_b, stops_a, lane))
        self.size_a, self.size_b = np.diff(self.stop_a, prepend=0), np.diff(self.stop_b, prepend=0)
        # Groups of each document, and each group's document.
        self.group_stops = np.searchsorted(self.stop_a, stops_a, side="right")
        self.n_groups = np.diff(self.group_stops, prepend=0)
        self.doc = np.repeat(np.arange(len(stops_a)), self.n_groups)
        self.width_b = len(vocab.bytes_b)

    def n_links(self) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(self.size_a * self.size_b)])
        return np.diff(total[self.group_stops], prepend=0)

    def digests(self) -> list[str]:
        """Digest of each document's groups as text; empty without tokens."""
        group_a, group_b = (np.repeat(np.arange(len(self.doc)), s) for s in (self.size_a, self.size_b))
        place_a = np.arange(len(self.a)) + (self.stop_b - self.size_b)[group_a]
        place_b = np.arange(len(self.b)) + self.stop_a[group_b]
        ids, after = np.empty(len(self.a) + len(self.b), np.int64), np.full(len(self.a) + len(self.b), ord(","), np.uint8)
        ids[place_a], ids[place_b] = self.a, self.b
        after[place_a[self.stop_a - 1]], after[place_b[self.stop_b - 1]] = ord("|"), ord(";")
        text, stops = spelled(ids, after)
        view, at, out = memoryview(text), 0, []
        for n in np.cumsum(self.n_a + self.n_b).tolist():
            stop = int(stops[n - 1]) if n else 0
            out.append(hashlib.sha256(view[at : stop - 1]).hexdigest() if stop > at else "")
            at = stop
        return out

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (document, id pair) keys in order, and how many links each stands for."""
        many = self.size_a * self.size_b
        small = np.flatnonzero(many <= WIDE)
        keys = []
        bounds = np.searchsorted(np.cumsum(many[small]), np.arange(0, int(many[small].sum()) + CHUNK, CHUNK))
        for lo, hi in zip(bounds, [*bounds[1:], len(small)]):
            g = small[lo:hi]
            if not len(g):
                continue
            n = many[g]
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            g = np.repeat(g, n)
            q = self.size_b[g]
            row = inner // q
            a = self.a[self.stop_a[g] - self.size_a[g] + row]
            b = self.b[self.stop_b[g] - q + (inner - row * q)]
            keys.append(self.doc[g] << PAIR_BITS | (a * self.width_b + b))
        found, times = np.unique(np.concatenate(keys), return_counts=True) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        wide = np.flatnonzero(many > WIDE)
        if len(wide):
            more = [(found, times)]
            for g in wide.tolist():
                a, times_a = np.unique(self.a[self.stop_a[g] - self.size_a[g] : self.stop_a[g]], return_counts=True)
                b, times_b = np.unique(self.b[self.stop_b[g] - self.size_b[g] : self.stop_b[g]], return_counts=True)
                pairs = (a[:, None] * self.width_b + b).ravel()
                more.append((self.doc[g] << PAIR_BITS | pairs, np.outer(times_a, times_b).ravel()))
            found, inverse = np.unique(np.concatenate([k for k, _ in more]), return_inverse=True)
            summed = np.zeros(len(found), np.int64)
            np.add.at(summed, inverse, np.concatenate([n for _, n in more]))
            times = summed
        return found, times


def packed(places: np.ndarray, times: np.ndarray) -> bytes:
    """Rising places as differences and how often each counts, by byte planes, compressed."""
    if not len(places):
        return b""
    cells = np.concatenate([np.diff(places, prepend=0), times]).astype("<u8")
    return zstandard.compress(np.ascontiguousarray(cells.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpacked(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.decompress(payload), np.uint8).reshape(8, -1)
    cells = np.ascontiguousarray(planes.T).view("<u8").ravel().astype(np.int64)
    half = len(cells) // 2
    return np.cumsum(cells[:half]), cells[half:]


class Block:
    """Documents gathered by a task until they make a block."""

    def __init__(self):
        self.columns, self.keys, self.times, self.n, self.size = [], [], [], 0, 0

    def add(self, ids: pa.Array, texts: list[str], vocab: Vocabularies) -> None:
        aligned = Aligned(*vocab.encode(texts), vocab)
        self.columns.append([ids, aligned.n_a, aligned.n_b, aligned.n_groups, aligned.n_links(), aligned.digests()])
        keys, times = aligned.links()
        self.keys.append(keys + (self.n << PAIR_BITS))
        self.times.append(times)
        self.n += len(texts)
        self.size += sum(map(len, texts))

    def full(self) -> bool:
        return self.size >= BLOCK_BYTES or self.n >= BLOCK_DOCS

    def rows(self, number: int) -> Iterator[pa.RecordBatch]:
        keys, times = np.concatenate(self.keys), np.concatenate(self.times)
        pairs, places, n_docs = np.unique(keys & ((1 << PAIR_BITS) - 1), return_inverse=True, return_counts=True)
        stops = np.searchsorted(keys >> PAIR_BITS, np.arange(self.n), side="right").tolist()
        del keys
        at = done = 0
        for ids, *numbers, digests in self.columns:
            payloads = []
            for stop in stops[done : done + len(ids)]:
                payloads.append(packed(places[at:stop], times[at:stop]))
                at = stop
            done += len(ids)
            known = [ids, *(pa.array(x) for x in numbers), pa.array(digests, pa.string()), pa.array(payloads, pa.binary())]
            yield self._batch(number, len(ids), known + [pa.nulls(len(ids), pa.int64())] * 3)
        for lo in range(0, len(pairs), 50_000):
            part = slice(lo, lo + 50_000)
            n = len(pairs[part])
            empty = [pa.nulls(n, t) for t in [pa.int64()] * 5 + [pa.string(), pa.binary()]]
            yield self._batch(number, n, [*empty, pa.array(pairs[part]), pa.array(np.arange(lo, lo + n)), pa.array(n_docs[part])])

    @staticmethod
    def _batch(number: int, n: int, columns: list) -> pa.RecordBatch:
        names = [f.split()[0] for f in STAGED.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, number)), *columns], names=names)


def aligned_blocks(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        vocab, block, number = vocabularies(path_a, path_b), Block(), TaskContext.get().partitionId() << 24
        for batch in slices(batches):
            block.add(batch.column("doc_id").cast(pa.int64()), texts_of(batch), vocab)
            if block.full():
                yield from block.rows(number)
                block, number = Block(), number + 1
        if block.n:
            yield from block.rows(number)

    return run


def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block, the totals of its pairs first."""
    names = [f.split()[0] for f in RESULT.split(", ")]
    block, totals = None, np.zeros(0, np.int64)
    for batch in batches:
        blocks = batch.column("block").to_numpy()
        for lo, hi in zip(starts := [0, *(np.flatnonzero(np.diff(blocks)) + 1)], [*starts[1:], len(blocks)]):
            if blocks[lo] != block:
                block, totals = blocks[lo], np.zeros(0, np.int64)
            part = batch.slice(lo, hi - lo)
            answers = part.filter(part.column("place").is_valid())
            if answers.num_rows:
                places = answers.column("place").to_numpy()
                if len(totals) <= places.max():
                    totals = np.concatenate([totals, np.zeros(max(len(totals), int(places.max()) + 1 - len(totals)), np.int64)])
                totals[places] = answers.column("total").to_numpy()
            docs = part.filter(part.column("payload").is_valid())
            if not docs.num_rows:
                continue
            best, summed = [], []
            for payload in docs.column("payload").to_pylist():
                if not payload:
                    best.append(0)
                    summed.append(0)
                    continue
                places, times = unpacked(payload)
                found = totals[places]
                best.append(int(times[found > 0].sum()))
                summed.append(int((np.abs(found) * times).sum()))
            kept = [docs.column(c) for c in names[:5]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(best, pa.int64()), pa.array(summed, pa.int64()), docs.column("groups_sha256")], names=names)


def pair_counts(rows: DataFrame) -> DataFrame:
    """Per id pair (``pair`` = A id times the size of B, plus B id) the documents that hold it linked."""
    return rows.where(F.col("pair").isNotNull()).groupBy("pair").agg(F.sum("n_docs").alias("count"))


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per document: tokens of both vocabularies, groups, links, links of the commonest partner of their A id, the sum
    of the links' document counts, and the digest of the groups."""
    width = len(sentencepiece.SentencePieceProcessor(model_file=path_b))
    found = staged(shipped(docs).select("doc_id", "text").mapInArrow(aligned_blocks(path_a, path_b), STAGED), "alignment")
    same_a = Window.partitionBy(F.floor(F.col("pair") / width))
    # A total is negative where another partner of the A id has more documents.
    totals = pair_counts(found).select("pair", F.when(F.col("count") == F.max("count").over(same_a), F.col("count")).otherwise(-F.col("count")).alias("total"))
    answers = found.where(F.col("pair").isNotNull()).select("block", "pair", "place").join(totals, "pair")
    kept = [f.split()[0] for f in STAGED.split(", ")][1:8]
    types = dict(f.split() for f in STAGED.split(", "))
    asked = found.where(F.col("pair").isNull()).select("block", *kept, F.lit(None).cast("long").alias("place"), F.lit(None).cast("long").alias("total"))
    told = answers.select("block", *[F.lit(None).cast(types[c]).alias(c) for c in kept], "place", "total")
    rows = asked.unionByName(told).repartition("block").sortWithinPartitions("block", F.col("place").asc_nulls_last())
    return rows.mapInArrow(add_up, RESULT)
