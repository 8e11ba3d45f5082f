"""Byte-level BPE encoding and decoding by batched numpy merge rounds.

The symbols of many words lie in one flat array. In each round the keys of all neighbouring pairs
are looked up by binary search in the sorted keys of the merge table, every word's lowest rank is
found, and all its places are merged. Words that are known already come from a bounded cache, so a
block of documents costs one rounds loop over its new words and one gather for all its ids.

Work is one pass over the input's own partitions; nothing is shuffled. A vocabulary file is a
parameter; it is read once in each Python worker (from a path that every node has).

Edge cases: a null text counts as empty; an empty text has no ids; a string of an added token in a
text is that token; ids that are not in the vocabulary decode to nothing; bytes that are not UTF-8
decode to U+FFFD; very long texts and words take more rounds, no other path; extra columns stay.
"""

from __future__ import annotations

import json
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary_array, equal_spans, gather, lanes_at, span_keys, table, text_blocks

CACHE_WORDS = 1_000_000  # about 40 bytes each
CACHE_LETTERS = 64  # longer pieces are not kept
BLOCK_BYTES = 1 << 20
MERGE_WORDS = 8192  # words in one flat array
CLASS_STEP = 1 << 14  # code points whose classes are asked for at once


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, others from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(own) else chr(next(rest)) for b in range(256)]


@cache
def library_classes() -> np.ndarray:
    """The class of every code point as the tokenizers library has it (its Unicode tables are its own), found by what it keeps together."""
    from tokenizers.pre_tokenizers import ByteLevel

    split = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    classes = np.zeros(0x110000, np.uint8)
    # in stretches: the pieces of all code points at once would be 400 MB of a worker while it starts
    for lo, hi in ((a, min(a + CLASS_STEP, end)) for begin, end in ((0, 0x80), (0x80, 0xD800), (0xE000, 0x110000)) for a in range(begin, end, CLASS_STEP)):
        signs = "".join(map(chr, range(lo, hi)))
        # neighbours that it keeps together are of one class, so one of each run is asked for
        runs = np.array([place[0] for _, place in split(signs)]) if lo >= 0x80 else np.arange(hi - lo)
        kind = np.full(len(runs), Pieces.SPACE)
        for beside, is_ in (("a", Pieces.LETTER), ("1", Pieces.NUMBER), ("!", Pieces.OTHER)):
            # beside + sign + line break: no piece begins at the sign if it is of that class
            begins = {place[0] for _, place in split("".join(f"{beside}{signs[i]}\n" for i in runs))}
            kind[[3 * i + 1 not in begins for i in range(len(runs))]] = is_
        classes[lo:hi] = np.repeat(kind, np.diff(np.r_[runs, hi - lo]))
    return classes


class Pieces:
    """Places where the pieces of UTF-8 texts begin, by array rules over classes of code points.

    They are those of the public byte-level pattern: contractions ('s 't 're 've 'm 'll 'd), an optional
    blank with letters, with numbers or with other signs, white space without the last blank before a
    piece, and other white space.
    """

    OTHER, LETTER, NUMBER, SPACE, ADDED = range(5)

    def __init__(self, added: list[str]):
        self.classes = library_classes()
        self.added = re.compile(b"|".join(re.escape(t.encode()) for t in sorted(added, key=len, reverse=True))) if added else None

    def starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Byte places of the first bytes of all pieces; no piece goes over a document's end."""
        at = np.flatnonzero((data & 0xC0) != 0x80)
        code = data[at].astype(np.int64)
        wide = np.flatnonzero(code >= 0xC0)
        if len(wide):
            lead, place = code[wide], at[wide]
            size = 2 + (lead >= 0xE0) + (lead >= 0xF0)
            value = lead & np.where(size == 2, 0x1F, np.where(size == 3, 0x0F, 0x07))
            for k in (1, 2, 3):
                more = size > k
                value[more] = value[more] << 6 | (data[place[more] + k] & 0x3F)
            code[wide] = value
        n = len(at)
        if not n:
            return at
        kind = self.classes[code]
        fresh = np.zeros(n + 1, bool)  # a text begins here, as far as the rules see
        fresh[np.searchsorted(at, offsets)] = True
        if self.added and b"<" in (raw := data.tobytes()):
            bounds = set(offsets.tolist())
            for m in self.added.finditer(raw):
                if not any(m.start() < x < m.end() for x in bounds) if len(bounds) < 64 else np.searchsorted(offsets, m.start(), side="right") == np.searchsorted(offsets, m.end(), side="left"):
                    lo, hi = np.searchsorted(at, (m.start(), m.end()))
                    kind[lo:hi] = self.ADDED
                    fresh[lo] = fresh[hi] = True
        first = fresh[:n].copy()
        first[0] = True
        first[1:] |= kind[1:] != kind[:-1]
        run = np.flatnonzero(first)
        end = np.r_[run[1:], n]
        # the last white space before other text: a blank joins what follows, anything else stands alone
        space = (kind[run] == self.SPACE) & ~fresh[end]
        last, follows = end[space] - 1, end[space]
        first[last] = True
        first[follows[code[last] == 0x20]] = False
        # contractions: an apostrophe that begins a piece, alone, before letters
        quote = np.flatnonzero((code == 0x27) & first)
        quote = quote[quote + 1 < n]
        quote = quote[(kind[quote + 1] == self.LETTER) & ~fresh[quote + 1]]
        if len(quote):
            one = code[quote + 1]
            next_ = np.minimum(quote + 2, n - 1)
            two = np.where((quote + 2 < n) & ~fresh[next_], code[next_], 0)
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            hit = short | long
            first[quote[hit] + 1] = False
            rest = quote[hit] + 2 + long[hit]
            rest = rest[rest < n]
            first[rest[kind[rest] == self.LETTER]] = True
        return at[first]


class ByteBPE:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        as_byte = {c: i for i, c in enumerate(letters)}
        self.first = np.array([vocab[c] for c in letters], np.int64)
        self.base = 1 + max([*vocab.values(), *[t["id"] for t in spec["added_tokens"]]])
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.bytes = [b""] * self.base
        for token, i in vocab.items():
            self.bytes[i] = bytes(as_byte[c] for c in token)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.added.items():
            self.bytes[i] = token.encode()
        self.pieces = Pieces(list(self.added))
        self.forget()

    def forget(self) -> None:
        """Known pieces: sorted names, where the ids of each lie in ``flat``, and where its bytes lie in ``raw`` (short names are the bytes)."""
        self.known, self.place, self.length, self.raw_place, self.raw_length = np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(4))
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.raw, self.raw_used = np.zeros(1 << 16, np.uint8), 0
        for token, i in self.added.items():
            data, one = np.frombuffer(token.encode(), np.uint8), np.array([len(token.encode())])
            self._learn(span_keys(data, np.array([0]), one), np.array([i], np.int32), np.array([1]), data, np.array([0]), one)

    def _learn(self, names: np.ndarray, ids: np.ndarray, counts: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        """Add pieces; ``names`` are sorted and new."""
        kept = np.where(lengths > 7, lengths, 0)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.raw_used + int(kept.sum()) + 8 > len(self.raw):
            self.raw = np.concatenate([self.raw, np.zeros_like(self.raw)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.raw[self.raw_used : self.raw_used + int(kept.sum())] = data[gather(starts, kept)]
        at = np.searchsorted(self.known, names)
        self.known = np.insert(self.known, at, names)
        self.place = np.insert(self.place, at, self.used + np.cumsum(counts) - counts)
        self.length = np.insert(self.length, at, counts)
        self.raw_place = np.insert(self.raw_place, at, self.raw_used + np.cumsum(kept) - kept)
        self.raw_length = np.insert(self.raw_length, at, kept)
        self.used += len(ids)
        self.raw_used += int(kept.sum())

    def merge_words(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the given spans in one array, and how many each has."""
        parts = [self._merge(self.first[data[gather(starts[a : a + MERGE_WORDS], lengths[a : a + MERGE_WORDS])]], lengths[a : a + MERGE_WORDS]) for a in range(0, len(starts), MERGE_WORDS)]
        if not parts:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _pair_ranks(self, symbols: np.ndarray, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rank of the pair that begins at each place ``at``; ``len(ranks)`` where there is none."""
        out = np.full(len(at), len(self.ranks), np.int64)
        inner = np.flatnonzero(at < len(symbols) - 1)
        inner = inner[owner[at[inner]] == owner[at[inner] + 1]]
        wanted = symbols[at[inner]] * self.base + symbols[at[inner] + 1]
        place = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        found = self.keys[place] == wanted
        out[inner[found]] = self.ranks[place[found]]
        return out

    def _merge(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words = len(lengths)
        owner = np.repeat(np.arange(words), lengths)
        never = len(self.ranks)
        rank = self._pair_ranks(symbols, owner, np.arange(len(symbols)))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            begins = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.repeat(np.minimum.reduceat(rank, begins), np.diff(np.r_[begins, len(symbols)]))
            over = lowest == never
            if over.any():
                done.append((owner[over], symbols[over]))
                rest = ~over
                symbols, owner, rank, lowest = symbols[rest], owner[rest], rank[rest], lowest[rest]
                if not len(symbols):
                    break
            chosen = np.flatnonzero(rank == lowest)
            # of overlapping places (a run of equal symbols) every second one counts, from the left
            place = np.arange(len(chosen))
            run_start = np.maximum.accumulate(np.where(np.r_[True, np.diff(chosen) > 1], place, 0))
            chosen = chosen[(place - run_start) % 2 == 0]
            symbols[chosen] = self.merged[rank[chosen]]
            keep = np.ones(len(symbols), bool)
            keep[chosen + 1] = False
            symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
            moved = chosen - np.arange(len(chosen))  # each merge to the left took one symbol away
            beside = np.zeros(len(symbols), bool)
            beside[moved] = True
            beside[np.maximum(moved - 1, 0)] = True
            changed = np.flatnonzero(beside)
            rank[changed] = self._pair_ranks(symbols, owner, changed)
        if not done:
            return np.zeros(0, np.int32), np.zeros(words, np.int64)
        owner, symbols = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
        order = np.argsort(owner, kind="stable")
        return symbols[order].astype(np.int32), np.bincount(owner, minlength=words)

    def encode_block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a block (UTF-8 bytes and text bounds) in one array, and how many each has.

        Pieces that share a name are compared byte by byte, within the block and with what is known; one that differs is encoded by itself.
        """
        starts = self.pieces.starts(data, offsets)
        lengths = np.diff(np.r_[starts, len(data)])
        names, some, piece = np.unique(self.names(data, starts, lengths), return_index=True, return_inverse=True)
        if len(self.known) > CACHE_WORDS:
            self.forget()
        lanes = lanes_at(data)
        at = np.minimum(np.searchsorted(self.known, names), max(len(self.known) - 1, 0))
        old = self.known[at] == names if len(self.known) else np.zeros(len(names), bool)
        new = some[~old]
        odd = np.zeros(len(starts), bool)
        long = np.flatnonzero((lengths > 7) & (some[piece] != np.arange(len(starts))))
        first = some[piece[long]]
        odd[long] = lengths[long] != lengths[first]
        long, first = long[~odd[long]], first[~odd[long]]
        odd[long] = ~equal_spans(lanes, starts[long], lanes, starts[first], lengths[long])
        seen = np.flatnonzero(old & (lengths[some] > 7))
        if len(seen):
            other = self.raw_length[at[seen]] != lengths[some[seen]]
            fit = seen[~other]
            wrong = np.r_[seen[other], fit[~equal_spans(lanes, starts[some[fit]], np.ndarray((len(self.raw) - 7,), "<u8", buffer=self.raw, strides=(1,)), self.raw_place[at[fit]], lengths[some[fit]])]]
            if len(wrong):
                odd |= np.isin(piece, wrong)
        if len(new):
            self._learn(names[~old], *self.encode_pieces(data, starts[new], lengths[new]), data, starts[new], lengths[new])
        at = np.searchsorted(self.known, names)[piece]
        counts, place, flat = self.length[at], self.place[at], self.flat
        if odd.any():
            ids, counts[odd] = self.encode_pieces(data, starts[odd], lengths[odd])
            place[odd] = self.used + np.cumsum(counts[odd]) - counts[odd]
            flat = np.concatenate([flat[: self.used], ids])
        ids = flat[gather(place, counts)]
        bounds = np.r_[0, np.cumsum(counts)][np.searchsorted(starts, offsets)]
        if len(new) and lengths[new].max() > CACHE_LETTERS and self.used > 4 * CACHE_WORDS:
            self.forget()
        return ids, np.diff(bounds)

    def names(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return span_keys(data, starts, starts + lengths)

    def encode_pieces(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.merge_words(data, starts, lengths)

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))


_LOADED: dict[tuple[type, str], ByteBPE] = {}


def loaded(path: str, kind: type[ByteBPE] = ByteBPE) -> ByteBPE:
    if (kind, path) not in _LOADED:
        _LOADED[kind, path] = kind(path)
    return _LOADED[kind, path]


def with_end(ids: np.ndarray, counts: np.ndarray, end: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and bounds of the texts, with an end id behind each text if one is given."""
    bounds = np.r_[0, np.cumsum(counts)]
    if end is None:
        return ids, bounds
    return np.insert(ids, bounds[1:], end), bounds + np.arange(len(bounds))


def encoder(path: str, text: str, out: str, kind: type[ByteBPE] = ByteBPE):
    """A function for mapInArrow: appends a binary column of little-endian unsigned 32-bit ids."""

    def run(batches):
        bpe = loaded(path, kind)
        for batch in batches:
            for at, data, offsets in text_blocks(batch.column(batch.schema.get_field_index(text)), BLOCK_BYTES):
                ids, bounds = with_end(*bpe.encode_block(data, offsets), None)
                rows = batch.slice(at, len(offsets) - 1)
                yield pa.RecordBatch.from_arrays([*rows.columns, binary_array(ids.astype("<u4"), bounds * 4)], names=[*rows.schema.names, out])

    return run


def encode(df: DataFrame, text: str = "text", out: str = "ids", tokenizer: str | None = None) -> DataFrame:
    """``df`` with ``out``: the ids of ``text`` as little-endian unsigned 32-bit integers (``ids_array`` makes them an array)."""
    from pyspark.sql.types import BinaryType, StructType

    df = df.drop(out)
    return df.mapInArrow(encoder(tokenizer or default_tokenizer(), text, out), StructType([*df.schema.fields]).add(out, BinaryType()))


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", tokenizer: str | None = None) -> DataFrame:
    """``df`` with ``out``: the text of the binary ids in ``ids``; special tokens are kept."""
    from pyspark.sql.types import StringType, StructType

    df = df.drop(out)
    path = tokenizer or default_tokenizer()

    def run(batches):
        bpe = loaded(path)
        limit = bpe.base
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            for a in range(0, max(batch.num_rows, 1), 256):
                rows = batch.slice(a, 256)
                texts = []
                for raw in column.slice(a, 256).to_pylist():
                    got = np.frombuffer(raw or b"", "<u4")
                    data = bpe.decode_bytes(got[got < limit])
                    texts.append(data.decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(texts, pa.string())], names=[*rows.schema.names, out])

    return df.mapInArrow(run, StructType([*df.schema.fields]).add(out, StringType()))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = encode(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    both = decode(ids)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
