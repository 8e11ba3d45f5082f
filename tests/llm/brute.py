"""Plain versions of the operators' contracts, and small tables with the hard cases."""

import hashlib
import math
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def documents():
    """Nulls, empty and long texts, repeated rows, ties, one source with most rows."""
    long = "x" * 3000 + " " + "palabra ñandú " * 400
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [
        (0, "plain text here", "en", "a", 15),
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, "  \n\t ", "en", "b", 5),
        (4, long, "es", "a", len(long)),
        (5, f"start {passage} tail one", "en", "a", 1),
        (6, f"other start {passage} and more {passage}", "en", "c", 1),
        (6, f"other start {passage} and more {passage}", "en", "c", 1),
        (None, f"{passage}", "en", None, 1),
        (7, "token=password=abcdefgh token=token:abcdef SECRET : 'abc' Api_Key=\"zzzzzz99\" passwd=a-b.c/d+", "en", "a", 1),
        (8, "AKIA" + "A1B2" * 4 + " AKIAAKIA AKIAAKIA" + "Z" * 12 + " " + "0123456789abcdef" * 2 + " deadbeef é漢🙂 secret=abcdef123456", "en", "a", 1),
        (9, "é🙂 password=hunter22", "fr", "a", 1),
        (10, "<|endoftext|> it's  a test　of 12３ bytes\x1c\x85 don't!!<|endoftext|>", "en", "a", 1),
        (11, "a" * 500, "en", "a", 500),
        (12, " ".join(f"w{i}" for i in range(100, 160)) + " " + passage[:40], "en", "a", 1),
    ]
    rows += [(100 + i, f"copy number shared text of a hot group {'same words again ' * 10}", "en", "a", 5) for i in range(40)]
    return rows


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def secrets(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    shown = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))
    return (*[sum(k == i for _, k, _ in spans) for i in range(3)], hashlib.sha256(shown.encode()).hexdigest(), shown)


def window_dedup(rows, width=20):
    """(doc_id, n_words, n_removed, kept_sha256) of distinct ids."""
    docs = sorted(((-math.inf if d is None else d), d, (WORD.findall(t) if t is not None else [])) for d, t in rows)
    first, out = {}, []
    for key, d, words in docs:
        for i in range(len(words) - width + 1):
            at = first.setdefault(tuple(words[i : i + width]), (key, i))
            first[tuple(words[i : i + width])] = min(at, (key, i))
    docs = [(key, d, WORD.findall(t) if t is not None else []) for d, t in rows for key in [-math.inf if d is None else d]]
    for key, d, words in docs:
        gone = [False] * len(words)
        for i in range(len(words) - width + 1):
            if first[tuple(words[i : i + width])] < (key, i):
                gone[i : i + width] = [True] * width
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((d, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def crc(text):
    return zlib.crc32((text or "").encode())
