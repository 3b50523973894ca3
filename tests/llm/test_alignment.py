"""Cross-tokenizer alignment against a plain walk over the libraries' own tokens."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm import helpers
from tidemark.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def plain_groups(texts):
    """Per text its groups as lists of A ids and B ids."""
    library, pieces = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    library.encode_special_tokens = True
    back = {c: bytes([b]) for b, c in enumerate(alignment.byte_alphabet())}
    for text in texts:
        if not text:
            yield []
            continue
        ids_a, ids_b = library.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)
        bytes_a = [b"".join(back[c] for c in library.id_to_token(i)) for i in ids_a]
        bytes_b = []
        for i in ids_b:
            p = pieces.id_to_piece(i)
            bytes_b.append(bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode())
        raw = (" " + text).encode()
        if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            yield []
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        cuts = sorted(set(ends_a) & set(ends_b))
        groups = [([], []) for _ in cuts]
        for side, ids, ends in ((0, ids_a, ends_a), (1, ids_b, ends_b)):
            g = 0
            for i, end in zip(ids, ends):
                groups[g][side].append(i)
                g += end == cuts[g]
        yield groups


def plain(rows):
    every = list(plain_groups([t for _, t in rows]))
    links = [Counter((a, b) for x, y in groups for a in x for b in y) for groups in every]
    count = Counter(p for link in links for p in link)
    top = defaultdict(int)
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    out = []
    for (doc_id, _), groups, link in zip(rows, every, links):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append(
            (
                doc_id, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(link.values()),
                sum(n for (a, b), n in link.items() if count[a, b] == top[a]), sum(n * count[p] for p, n in link.items()),
                hashlib.sha256(text.encode()).hexdigest() if groups else "",
            )
        )
    return sorted(out, key=str)


def result(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=str)


ODD = ["▁x", "a\x00b", "  a  b ", "a\tb\n\n\n\nc", "日本語 " * 40, "\U0001f642" * 30, "<|endoftext|> <s> <unk> <0x41>", " " * 4000]


def test_alignment_is_the_plain_one(spark):
    rows = [(r[0], r[1], "clash") for r in helpers.odd_documents()] + [(500 + n, t, "x") for n, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, payload string").repartition(3)
    assert result(alignment.align(docs, A, B)) == plain([r[:2] for r in rows])
    assert alignment.align(docs.limit(0), A, B).count() == 0


def test_many_blocks_and_short_lanes(spark, data, monkeypatch):
    """Blocks of a few documents share pairs; totals are those of the whole table."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert result(alignment.align(docs.repartition(11), A, B)) == plain(rows)


def test_blocks_are_closed_and_told_apart(monkeypatch):
    """One task writes several blocks, each with its own pairs and places."""
    import pyarrow as pa
    import pyspark

    monkeypatch.setattr(pyspark, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": lambda self: 3})())}))
    monkeypatch.setattr(alignment, "BLOCK_DOCS", 2)
    texts = [helpers.prose(30 + n, n) for n in range(6)]
    batches = [pa.RecordBatch.from_arrays([pa.array([n, n + 1]), pa.array(texts[n : n + 2])], names=["doc_id", "text"]) for n in (0, 2, 4)]
    rows = pa.Table.from_batches(list(alignment.aligned_blocks(A, B)(iter(batches)))).to_pylist()
    assert {r["block"] for r in rows} == {(3 << 24) + n for n in range(3)}
    width = len(alignment.vocabularies(A, B).bytes_b)
    want = [Counter((a, b) for x, y in g for a in x for b in y) for g in plain_groups(texts)]
    for r in rows:
        if r["pair"] is None:
            names = {s["place"]: s["pair"] for s in rows if s["block"] == r["block"] and s["pair"] is not None}
            places, times = alignment.unpacked(r["payload"])
            assert {divmod(names[p], width): n for p, n in zip(places.tolist(), times.tolist())} == want[r["doc_id"]]
        else:
            first = 2 * (r["block"] & 0xFF)
            assert r["n_docs"] == sum(divmod(r["pair"], width) in w for w in want[first : first + 2])


def check_aligned(texts, lane):
    vocab = alignment.vocabularies(A, B)
    found = alignment.Aligned(*vocab.encode(texts), vocab, lane)
    digests, (keys, times), want = found.digests(), found.links(), list(plain_groups(texts))
    got = [Counter() for _ in texts]
    for k, n in zip(keys.tolist(), times.tolist()):
        got[k >> alignment.PAIR_BITS][divmod(k & ((1 << alignment.PAIR_BITS) - 1), len(vocab.bytes_b))] += n
    assert got == [Counter((a, b) for x, y in g for a in x for b in y) for g in want]
    assert found.n_groups.tolist() == [len(g) for g in want] and found.n_links().tolist() == [sum(c.values()) for c in got]
    for d, g in zip(digests, want):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        assert d == (hashlib.sha256(text.encode()).hexdigest() if g else "")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(max_codepoint=0x2FFF, exclude_categories=["Cs"]), max_size=50), max_size=5), st.integers(1, 9))
def test_lanes_change_nothing(texts, lane):
    check_aligned(texts, lane)


def test_wide_groups_go_through_distinct_ids(monkeypatch):
    monkeypatch.setattr(alignment, "WIDE", 3)
    monkeypatch.setattr(alignment, "CHUNK", 50)
    check_aligned([helpers.prose(200, 1), *ODD, helpers.prose(90, 2)], 16)


def test_long_text():
    """Ten megabytes in one document."""
    vocab, text = alignment.vocabularies(A, B), helpers.prose(40_000, 5) + " "
    text *= 10_000_000 // len(text)
    found = alignment.Aligned(*vocab.encode([text, "end"]), vocab)
    assert found.n_groups[0] > 1_000_000 and found.stop_a[-1] == len(found.a) and found.stop_b[-1] == len(found.b)
    assert (vocab.sizes_a[found.a].sum(), vocab.sizes_b[found.b].sum()) == (len(text) + 1 + 4, len(text) + 1 + 4)
