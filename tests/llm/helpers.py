"""Small inputs with every odd case, and plain Python versions of the operators."""

from __future__ import annotations

import re
from collections import defaultdict

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = (
    "the river runs past the old mill and on through the quiet town where the children play beside the stone bridge in the warm light of the "
    "evening while their parents talk about the harvest the weather and the long road to the city"
).split()


def prose(n: int, seed: int) -> str:
    """Words in a seeded order, a line break now and then."""
    out, x = [], seed * 7919 + 1
    for i in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(PROSE[(x >> 8) % len(PROSE)] + str(x % 9 if x % 7 == 0 else "") + ("\n" if x % 23 == 0 else ""))
    return " ".join(out)


def odd_documents() -> list[tuple]:
    """Null and empty cells, one very long text, copies, near copies, odd characters, repeated rows."""
    a = prose(300, 1)
    near = a.replace("river", "stream", 1)
    texts = [
        None, "", " ", "\n\n", "a", "one two three", "\u0001x\u0002", "<|endoftext|> hi <|startoftext|>", "Σίσυφος ΣΑΣ é ﬁ 日本語 🙂🙂", "՘ Ɤ odd letters",
        a, a, near, prose(300, 2), prose(60, 3), prose(120_000, 4), "x" * 50_000, "1 " * 3000, "a.b" * 4000, "-" * 3000 + "\n" * 500, "\x1c\x85    end", "*** !!!", " *** !!!",
    ]
    rows = [(n, t, "en" if n % 4 else None, None if n % 5 == 0 else f"s{n}", None if t is None else len(t)) for n, t in enumerate(texts)]
    return rows + [rows[10], rows[13], rows[13], (None, prose(80, 9), "en", "s", 1), (None, None, None, None, None)]


def documents(spark, rows=None):
    return spark.createDataFrame(odd_documents() if rows is None else rows, SCHEMA)


def luhn(digits: str) -> bool:
    doubled = [int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def personal(text: str) -> list[tuple]:
    """(start, order, end, kind) of the base spans of personal data."""
    out = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        out += [(m.start(), 2, m.end(), "card")] * (14 <= len(digits) <= 19 and luhn(digits))
    out += [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out)


def secrets(text: str) -> list[tuple]:
    """(start, order, end, kind) of the base spans of secrets."""
    assign = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out = [(m.start(), 0, m.end(), "assign") for m in re.finditer(assign, text, re.ASCII) if len(m.group(1)) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(out)


def license_words(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))


def near_pairs(rows: list[tuple]) -> tuple[list[int], list[int | None]]:
    """Per row the number of similar rows and the class id, over all pairs."""
    sets = []
    for doc_id, text in rows:
        words = re.findall(r"\w+", (text or "").lower()) or list(filter(None, [(text or "").strip()]))
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words and doc_id is not None else set())
    links, parent = [0] * len(rows), list(range(len(rows)))

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            shared = len(a & sets[j])
            if shared and 5 * shared >= 4 * len(a | sets[j]):
                links[i], links[j] = links[i] + 1, links[j] + 1
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        least[root(i)].append(doc_id)
    return links, [None if rows[i][0] is None else min(least[root(i)]) for i in range(len(rows))]
