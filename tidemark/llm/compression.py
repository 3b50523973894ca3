"""Quality rules by compression: text that shrinks too much repeats itself, text that shrinks too little is noise.

The ratio is compressed size over plain size under zstandard, for the whole document and for each fixed chunk of
``CHUNK`` bytes. Small inputs compress worse, so limits depend on the length: ``BANDS`` lists (bytes from, lowest
ratio, highest ratio), the last entry at or below the length counts. A document fails when its own ratio leaves its
band, or when more than ``MAX_BAD_CHUNKS`` of its chunks leave theirs (a last chunk below ``LEAST_CHUNK`` bytes is
not judged). The base rules come first: fewer than 50 words, or more than half of the words inside repeated
three-word windows.

Null text holds no words and fails by the base rules, as empty text does. Every row is judged alone, so repeated
rows get repeated results; a very long text is judged whole. An empty table gives no rows. Work is one pass over the
documents without a shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import shipped, slices, texts_of

LEVEL = 3
CHUNK, LEAST_CHUNK = 8192, 2048
MAX_BAD_CHUNKS = 0.25
# Lowest and highest ratio by length in bytes.
BANDS = [(0, 0.0, 1.5), (256, 0.12, 0.95), (1024, 0.14, 0.85), (4096, 0.12, 0.75), (16384, 0.09, 0.70)]

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
ADDED = ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, ratio double, bad_chunks double"


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found at least twice."""
    windows = list(zip(words, words[1:], words[2:]))
    seen = Counter(windows)
    if len(seen) == len(windows):
        return 0
    hit = np.zeros(len(words), bool)
    at = np.flatnonzero([seen[w] > 1 for w in windows])
    hit[at] = hit[at + 1] = hit[at + 2] = True
    return int(hit.sum())


def base_counts(text: str, raw: bytes) -> list[int]:
    """The five counts of ``COUNTS``."""
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip()]
    spaces = len(raw) - len(raw.translate(None, SPACE))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    return [len(words), len(text) - spaces, symbols, len(lines) - len(set(lines)), repeat_words(words)]


def limits(size: int, bands=BANDS) -> tuple[float, float]:
    low, high = bands[0][1:]
    for start, a, b in bands:
        if size >= start:
            low, high = a, b
    return low, high


def in_band(raw: bytes, pack: zstandard.ZstdCompressor, bands=BANDS) -> tuple[float, bool]:
    if not raw:
        return 0.0, True
    ratio = len(pack.compress(raw)) / len(raw)
    low, high = limits(len(raw), bands)
    return ratio, low <= ratio <= high


def judge(raw: bytes, pack: zstandard.ZstdCompressor, bands=BANDS, chunk: int = CHUNK) -> tuple[float, float, bool]:
    """Ratio of the whole, share of chunks outside their band, and whether the text passes."""
    ratio, fine = in_band(raw, pack, bands)
    if len(raw) <= chunk:
        return ratio, 0.0, fine
    cuts = [raw[i : i + chunk] for i in range(0, len(raw), chunk)]
    cuts = [c for c in cuts if len(c) >= min(LEAST_CHUNK, chunk)]
    bad = sum(not in_band(c, pack, bands)[1] for c in cuts) / len(cuts)
    return ratio, bad, fine and bad <= MAX_BAD_CHUNKS


def measures(text: str, pack: zstandard.ZstdCompressor, bands=BANDS, chunk: int = CHUNK) -> list:
    raw = text.encode("utf-8", "surrogatepass")
    counts = base_counts(text, raw)
    failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
    ratio, bad, fine = judge(raw, pack, bands, chunk)
    return [*counts, failed, not failed and fine, ratio, bad]


def quality(docs: DataFrame, bands=BANDS, chunk: int = CHUNK) -> DataFrame:
    """All columns of the documents and those of ``ADDED``, which replace columns of the same name."""
    names = [f.split()[0] for f in ADDED.split(", ")]
    kept = [c for c in docs.columns if c not in names]
    docs = shipped(docs).select(*[F.col(f"`{c}`") for c in kept])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", " + ADDED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=LEVEL)
        types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
        for batch in slices(batches):
            found = list(zip(*[measures(t, pack, bands, chunk) for t in texts_of(batch)]))
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(x, k) for x, k in zip(found, types)]], names=[*kept, *names])

    return docs.mapInArrow(run, schema)
