"""Token counts without ids: pieces are counted once per distinct pre-token, then summed over frequencies.

1. Each task cuts its whole texts into pre-tokens, and turns a block of documents (a task's partition up to
   ``BLOCK_DOCS`` documents or ``BLOCK_BYTES`` of text) into postings: per distinct pre-token the places of its
   documents in the block, a place repeated as often as the document holds the pre-token.
2. Postings are shuffled by pre-token. A task counts the pieces of each distinct pre-token once, with the
   vocabulary's library, looks them up for its postings and adds them up per document of the block.
3. These sums are shuffled by block and added; a block's first row carries its doc ids and text sizes.

The key of a posting is its pre-token and a number that stands for ``GROUP`` input partitions, so a key holds the blocks of
that many partitions however large the corpus is; a pre-token is counted once per such group. A pre-token of more
than a quarter of a block's documents is spread over ``SPREAD`` keys a group by its block. So no task
gathers the postings of a word that every document holds. State is bounded: sums and counted pre-tokens are
let go beyond ``STATE``, as sums can be added in parts. Documents are told apart by their place, so repeated rows
and doc ids stay separate, null ids too; null text counts as empty (0 bytes, 0 tokens). A very long text is cut whole
and makes a block alone. An empty table gives no rows. Columns other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm.bpe_trie import BYTE_LEVEL_PATTERN, UNSTABLE
from tidemark.llm.common import shipped, slices, texts_of

BLOCK_DOCS, BLOCK_BYTES = 60_000, 32_000_000
# Places in a block are two bytes.
PLACES = 1 << 16
# A block's number is its task's partition and, in these bits, its place in the partition.
BLOCK_BITS = 24
SPREAD = 32
# Input partitions whose postings of a word share a key.
GROUP = 64
STATE = 4_000_000
POSTINGS = "salt int, word string, block long, payload binary"
RESULT = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


class Counter:
    """Pre-tokens of texts and pieces of pre-tokens, for one byte-level vocabulary file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.words = regex.compile(BYTE_LEVEL_PATTERN)
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def split(self, text: str) -> list[str]:
        if self.cut is None or not self.cut.search(text):
            return self._words(text)
        out = []
        for n, part in enumerate(self.cut.split(text)):
            out += [part] if n % 2 else self._words(part)
        return out

    def _words(self, text: str) -> list[str]:
        if UNSTABLE.search(text):  # characters that Unicode versions see differently: the library's own split
            return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]
        return self.words.findall(text)

    def pieces(self, words: list[str]) -> list[int]:
        return [len(e.ids) for e in self.library.encode_batch_fast(words, add_special_tokens=False)]


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


class Block:
    """Documents gathered by a task until they make a block."""

    def __init__(self):
        self.code: dict[str, int] = {}
        self.codes, self.places, self.ids, self.sizes = [], [], [], []

    def add(self, ids: list, texts: list[str], split) -> None:
        code = self.code
        for i, text in zip(ids, texts):
            found = [code.setdefault(w, len(code)) for w in split(text)]
            self.codes.append(np.array(found, np.uint32))
            self.places.append(np.full(len(found), len(self.ids), np.uint16))
            self.ids.append(i)
            self.sizes.append(len(text.encode("utf-8", "surrogatepass")))

    def room(self) -> int:
        """Documents that still have a place number."""
        return PLACES - len(self.ids)

    def full(self) -> bool:
        return len(self.ids) >= BLOCK_DOCS or sum(self.sizes) >= BLOCK_BYTES

    def rows(self, number: int) -> Iterator[pa.RecordBatch]:
        """The block's first row, then its postings in runs."""
        head = pa.array(self.ids, pa.int64()), pa.array(self.sizes, pa.int64())
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, (table := pa.RecordBatch.from_arrays(list(head), names=["doc_id", "n_bytes"])).schema) as out:
            out.write_batch(table)
        yield posting_batch([number % SPREAD], [None], number, [sink.getvalue().to_pybytes()])
        codes = np.concatenate(self.codes) if self.codes else np.zeros(0, np.uint32)
        places = np.concatenate(self.places) if self.places else np.zeros(0, np.uint16)
        self.codes = self.places = None
        order = np.argsort(codes, kind="stable")
        codes, places = codes[order], places[order]
        ends = np.cumsum(np.bincount(codes, minlength=len(self.code))) if len(codes) else np.zeros(0, np.int64)
        words, starts = list(self.code), np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        for at in range(0, len(words), 20_000):
            stop = min(at + 20_000, len(words))
            runs = [places[starts[k] : ends[k]] for k in range(at, stop)]
            first = (number >> BLOCK_BITS) // GROUP * SPREAD
            salts = [first + (number % SPREAD if 4 * len(r) > len(self.ids) and len(r) > 64 else 0) for r in runs]
            yield posting_batch(salts, words[at:stop], number, [r.tobytes() for r in runs])


def posting_batch(salts: list[int], words: list, block: int, payloads: list[bytes]) -> pa.RecordBatch:
    columns = [pa.array(salts, pa.int32()), pa.array(words, pa.string()), pa.array([block] * len(words), pa.int64()), pa.array(payloads, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["salt", "word", "block", "payload"])


def postings(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        count, block, number = counter(path), Block(), TaskContext.get().partitionId() << BLOCK_BITS
        for batch in slices(batches):
            ids, texts, at = batch.column("doc_id").to_pylist(), texts_of(batch), 0
            while at < len(ids):
                stop = at + block.room()
                block.add(ids[at:stop], texts[at:stop], count.split)
                at = stop
                if block.full():
                    yield from block.rows(number)
                    block, number = Block(), number + 1
        if block.ids:
            yield from block.rows(number)

    return run


def partial_sums(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, known, sums, held = counter(path), {}, {}, 0

        def flush() -> Iterator[pa.RecordBatch]:
            for block, total in sums.items():
                yield posting_batch([0], [""], block, [np.trim_zeros(total, "b").astype(np.uint32).tobytes()])

        for batch in batches:
            words, payloads, blocks = batch.column("word").to_pylist(), batch.column("payload").to_pylist(), batch.column("block").to_pylist()
            new = list({w for w in words if w is not None and w not in known})
            if len(known) + len(new) > STATE // 8:
                known, new = {}, list({w for w in words if w is not None})
            known.update(zip(new, count.pieces(new)))
            by_block: dict[int, list[int]] = {}
            for i, b in enumerate(blocks):
                if words[i] is None:
                    yield batch.slice(i, 1)
                else:
                    by_block.setdefault(b, []).append(i)
            for b, rows in by_block.items():
                runs = [np.frombuffer(payloads[i], np.uint16) for i in rows]
                weights = np.repeat([known[words[i]] for i in rows], [len(r) for r in runs])
                found = np.bincount(np.concatenate(runs), weights).astype(np.int64)
                old = sums.get(b)
                if old is None or len(old) < len(found):
                    grown = np.zeros(len(found), np.int64)
                    if old is not None:
                        grown[: len(old)] = old
                    held += len(found) - (0 if old is None else len(old))
                    sums[b] = old = grown
                old[: len(found)] += found
            if held > STATE:
                yield from flush()
                sums, held = {}, 0
        yield from flush()

    return run


def add_up(limit: int):
    """Rows come sorted by block, its head (no word) first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = total = block = None

        def close() -> Iterator[pa.RecordBatch]:
            if head is not None:
                ids, sizes = head.column("doc_id"), head.column("n_bytes")
                over = pa.array(total > limit)
                yield pa.RecordBatch.from_arrays([ids, sizes, pa.array(total), over], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

        for batch in batches:
            for word, b, payload in zip(*(batch.column(c).to_pylist() for c in ("word", "block", "payload"))):
                if b != block:
                    yield from close()
                    block, head = b, pa.ipc.open_stream(payload).read_next_batch()
                    total = np.zeros(head.num_rows, np.int64)
                else:
                    part = np.frombuffer(payload, np.uint32)
                    total[: len(part)] += part
        yield from close()

    return run


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit (more tokens than ``limit``)."""
    found = shipped(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(postings(path), POSTINGS)
    summed = found.repartition("word", "salt").mapInArrow(partial_sums(path), POSTINGS)
    by_block = summed.repartition("block").sortWithinPartitions("block", F.col("word").asc_nulls_first())
    return by_block.mapInArrow(add_up(limit), RESULT)
