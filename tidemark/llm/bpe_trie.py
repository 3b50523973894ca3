"""BPE encoding and decoding: the distinct words of a slice of documents share the work of their prefixes.

Words are visited in sorted order, which walks their trie depth first. Every node (a prefix) keeps one
thing: the last token of the prefix's encoding. It is the longest vocabulary entry ending there that can
follow the last token of the node where that entry starts; two neighbours are allowed when merging their
text gives the same two tokens back. A word's encoding is read off by stepping back from its end.
So the encoding of a shared prefix is found once, whatever number of words continues it.

Null text counts as empty: no tokens, empty decoding. Repeated rows give repeated results. A very long text is encoded
whole, alone in its slice; an empty table gives no rows. Other columns are kept; the columns added are listed with each function, and a clashing input column is replaced.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm.common import ragged, shipped, slices, texts_of

# Fixed value: the split pattern of byte-level BPE files that carry none of their own.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Characters that every Unicode version of the last years classifies alike. Texts with others go through the library.
STABLE = "\0-՗֍-ࢎ࢐-౛ౝ-೛ೝ-ᲈ᲋-₎₠-Ꟊ"
UNSTABLE = re.compile(f"[^{STABLE}]")
# Added to the code of a word's last character where the vocabulary marks word ends.
END = 0x400
# Distinct words whose encodings a task remembers from slice to slice.
KEPT_WORDS = 200_000
# Pairs of neighbours and reached texts that a task remembers.
KEPT_STEPS = 2_000_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte value in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table, extra = [""] * 256, 0x100
    for b in range(256):
        table[b] = chr(b) if b in shown else chr(extra)
        extra += b not in shown
    return table


class TrieEncoder:
    """Encoder and decoder for a BPE vocabulary file of the tokenizers library (byte level or word ends)."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in {**self.vocab, **self.special}.items()}
        parts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [spec["pre_tokenizer"]])
        patterns = [p["pattern"]["Regex"] for p in parts if p and p["type"] == "Split"]
        self.words = regex.compile(patterns[0] if patterns else BYTE_LEVEL_PATTERN)
        self.normalises = spec["normalizer"] is not None
        self.byte_decoder = (spec["decoder"] or {}).get("type") == "ByteLevel"
        found = "|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))
        self.cut = re.compile(f"({found})") if found else None
        alphabet = byte_alphabet()
        self.to_symbols = {b: alphabet[b] for b in range(256)}
        self.from_symbols = {ord(c): b for b, c in enumerate(alphabet)}
        # Tokens as strings with one character per symbol.
        self.token_id = {self._symbols(t): i for t, i in self.vocab.items()}
        self.rank: dict[tuple[str, str], int] = {}
        for n, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.rank[self._symbols(a), self._symbols(b)] = n
        self.starts = {t[:n] for t in self.token_id for n in range(1, len(t) + 1)}
        self.made: dict[str, tuple[str, str] | None] = {}
        self.allowed: dict[tuple[str, str], bool] = {}
        self.follow: dict[str, str] = {}
        self.ends: dict[str, tuple[str, ...]] = {}
        self.known: dict[str, np.ndarray] = {}

    def _symbols(self, token: str) -> str:
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            token = token[: -len(self.suffix)]
            return token[:-1] + chr(ord(token[-1]) + END)
        return token

    def word_symbols(self, word: str) -> str:
        s = word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.to_symbols)
        return s[:-1] + chr(ord(s[-1]) + END) if self.suffix else s

    # ---- which tokens may stand side by side

    def origin(self, token: str) -> tuple[str, str] | None:
        """The two tokens whose merge makes this one; None for a single symbol or one that merging never reaches."""
        if token not in self.made:
            run = list(token)
            last = None
            while len(run) > 1:
                ranked = [(self.rank.get(p, len(self.rank)), i) for i, p in enumerate(zip(run, run[1:]))]
                best, at = min(ranked)
                if best == len(self.rank):
                    break
                last = (run[at], run[at + 1])
                run[at : at + 2] = [run[at] + run[at + 1]]
            self.made[token] = last if len(run) == 1 else None
        return self.made[token]

    def reachable(self, token: str) -> bool:
        return len(token) == 1 or self.origin(token) is not None

    def age(self, token: str) -> int:
        pair = self.origin(token)
        return -1 if pair is None else self.rank[pair]

    def side_by_side(self, a: str, b: str) -> bool:
        """Whether merging the text of both leaves the border between them: undo the younger side's merges
        one by one; none of the border pairs seen on the way may merge before the merge undone last."""
        key = (a, b)
        if key not in self.allowed:
            limit = len(self.rank)
            while True:
                if self.rank.get((a, b), limit) < limit:
                    self.allowed[key] = False
                    break
                left, right = self.age(a), self.age(b)
                if left < 0 and right < 0:
                    self.allowed[key] = True
                    break
                if left > right:
                    limit, a = left, self.origin(a)[1]
                else:  # of two equal merges the left one comes first
                    limit, b = right + 1, self.origin(b)[0]
        return self.allowed[key]

    # ---- the walk

    def step(self, reached: str) -> str:
        """The longest ending of a text that some token starts with."""
        if reached not in self.follow:
            s = reached
            while s and s not in self.starts:
                s = s[1:]
            self.follow[reached] = s
        return self.follow[reached]

    def endings(self, state: str) -> tuple[str, ...]:
        """Tokens that end here, longest first."""
        if state not in self.ends:
            every = (state[i:] for i in range(len(state)))
            self.ends[state] = tuple(t for t in every if t in self.token_id and self.reachable(t))
        return self.ends[state]

    def encode_sorted(self, words: list[str]) -> list[list[int]]:
        """Encodings of distinct words given as symbols in sorted order."""
        out, before = [], ""
        states, last = [""], [""]
        follow, ends, allowed, token_id = self.follow, self.ends, self.allowed, self.token_id
        for word in words:
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del states[shared + 1 :], last[shared + 1 :]
            for i in range(shared, len(word)):
                reached = states[i] + word[i]
                state = follow.get(reached)
                if state is None:
                    state = self.step(reached)
                choices = ends.get(state)
                if choices is None:
                    choices = self.endings(state)
                for token in choices:
                    size = len(token)
                    if size > i:
                        break
                    pair = (last[i + 1 - size], token)
                    fits = allowed.get(pair)
                    if fits or fits is None and self.side_by_side(*pair):
                        break
                else:
                    raise ValueError(f"no token for {word[: i + 1]!r}")
                states.append(state)
                last.append(token)
            ids, at = [], len(word)
            while at:
                ids.append(token_id[last[at]])
                at -= len(last[at])
            out.append(ids[::-1])
            before = word
        return out

    def learn(self, words: list[str]) -> None:
        """Encode the words not yet known, all through one walk."""
        if not self.known or len(self.known) > KEPT_WORDS:
            self.known = {s: np.array([i], np.uint32) for s, i in self.special.items()}
        if len(self.allowed) + len(self.follow) > KEPT_STEPS:
            self.allowed, self.follow, self.ends = {}, {}, {}
        new = {self.word_symbols(w): w for w in words if w not in self.known}
        order = sorted(new)
        for symbols, ids in zip(order, self.encode_sorted(order)):
            self.known[new[symbols]] = np.array(ids, np.uint32)

    # ---- texts

    def normalise(self, text: str) -> str:
        """Canonical composition and lower case. White space only separates words here, so it is left alone."""
        if not self.normalises or text.isascii():
            return text.lower() if self.normalises else text
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def split(self, text: str) -> list[str]:
        """A text's words, special strings as words of their own."""
        if self.cut is None or not self.cut.search(text):
            return self.words.findall(self.normalise(text))
        out = []
        for n, part in enumerate(self.cut.split(text)):
            out += [part] if n % 2 else self.words.findall(self.normalise(part))
        return out

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        split = [None if UNSTABLE.search(t) else self.split(t) for t in texts]
        self.learn(list({w for s in split if s for w in s}))
        known, out = self.known, []
        for text, words in zip(texts, split):
            if words is None:
                out.append(np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32))
            else:
                out.append(np.concatenate([known[w] for w in words]) if words else np.zeros(0, np.uint32))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: bytes put together where the file names a byte decoder, else tokens joined by spaces."""
        if not self.byte_decoder:
            return " ".join(map(self.names.__getitem__, ids.tolist()))
        return self.library.decode(ids.tolist(), skip_special_tokens=False)


@lru_cache(maxsize=2)
def encoder(path: str) -> TrieEncoder:
    """One per Python worker."""
    return TrieEncoder(path)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the token ids of every text as an array column."""
    kept = [c for c in docs.columns if c != ids]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema) + f", `{ids}` array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in slices(batches, text):
            flat, starts = ragged(enc.encode_batch(texts_of(batch, text)), np.int64)
            column = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*kept, ids])

    return shipped(docs).select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)


def decode(docs: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add the text of an id column; null ids give null."""
    @F.pandas_udf("string")
    def run(column):
        enc = encoder(path)
        return column.map(lambda x: None if x is None else enc.decode(np.asarray(x, np.int64)))

    return shipped(docs).withColumn(text, run(F.col(f"`{ids}`")))


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip_digest(docs: DataFrame, path: str) -> DataFrame:
    """Per document: number of ids, digest of the ids, digest of the text decoded from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in slices(batches):
            every = enc.encode_batch(texts_of(batch))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array([len(x) for x in every], pa.int64()),
                    pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in every]),
                    pa.array([hashlib.sha256(enc.decode(x).encode()).hexdigest() for x in every]),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return shipped(docs).select("doc_id", "text").mapInArrow(run, DIGEST)
