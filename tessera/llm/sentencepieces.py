"""SentencePiece (BPE) encoding with source offsets, and decoding.

A text is normalised first: at each place the longest prefix that the model's compiled character map
holds is replaced (the map is a double-array trie; all places of a block walk it at once, and two
or three steps leave few of them), white space is collapsed if the model says so, a blank goes before the
text, and blanks become U+2581. Every normalised byte keeps the source byte that it came from, so a
piece, whose length in normalised bytes the vocabulary knows, is projected to its span of source bytes.

Pieces never go on over a U+2581 that follows another sign, so the stretches between are merged
on their own, in flat arrays for many of them, and known ones come from a bounded cache (both as in
``bpe``). A round merges every stretch's pair of best score: all its places, or the leftmost one if a
better pair can come from it. Where pieces share a score (runs of blanks) and in long stretches an
agenda pops one pair after the other, the best first and the leftmost of equals.

Work is one pass over the input's own partitions; nothing is shuffled. The model file is a parameter;
it is read once in each Python worker.

Edge cases: a null text counts as empty; an empty text has no ids; signs without a piece become byte
pieces, of which the last holds the sign's span and the others are empty; very long texts and stretches
are whole; ids that are not in the vocabulary decode to nothing; bytes that are not UTF-8 decode to
U+FFFD one by one; extra columns stay. Models other than BPE with byte pieces are refused.
"""

from __future__ import annotations

import heapq
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import BLOCK_BYTES, ByteBPE, loaded
from .common import gather, table, text_blocks

LONG = 1024  # symbols of a stretch from which the agenda is used
#: The sign for a blank, and the kinds of pieces in a model file.
BLANK = "▁".encode()
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def message(raw: bytes):
    """(field number, value) of a protocol-buffer message: numbers as int, the rest as bytes."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = raw[at]
            value, shift, at = value | (byte & 127) << shift, shift + 7, at + 1
            if byte < 128:
                return value, at

    at = 0
    while at < len(raw):
        key, at = number(at)
        if key & 7 == 0:
            value, at = number(at)
        else:
            size, at = number(at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = raw[at : at + size], at + size
        yield key >> 3, value


class CharacterMap:
    """Longest-prefix replacement rules, compiled as a double-array trie whose values are places in a table of strings."""

    def __init__(self, compiled: bytes):
        size = struct.unpack_from("<I", compiled)[0] if compiled else 0
        self.units = np.frombuffer(compiled, "<u4", size // 4, 4).astype(np.int64) if compiled else np.zeros(0, np.int64)
        self.strings = compiled[4 + size :]

    @staticmethod
    def _step(units: np.ndarray) -> np.ndarray:
        return (units >> 10) << ((units & 512) >> 6)

    def matches(self, data: np.ndarray, places: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places where a rule begins (in order), the bytes of the longest one, and its value. ``ends``: where the text of each place ends."""
        length, value = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
        if len(self.units):
            live = np.arange(len(places))
            node = np.full(len(places), self._step(self.units[:1])[0])
            depth = 0
            while len(live):
                inside = places[live] + depth < ends[live]
                live, node = live[inside], node[inside]
                byte = data[places[live] + depth].astype(np.int64)
                node = node ^ byte
                unit = self.units[np.minimum(node, len(self.units) - 1)]
                hit = (node < len(self.units)) & ((unit & (1 << 31 | 255)) == byte)
                live, node, unit = live[hit], node[hit], unit[hit]
                node = node ^ self._step(unit)
                depth += 1
                leaf = np.flatnonzero(unit >> 8 & 1)
                length[live[leaf]] = depth
                value[live[leaf]] = self.units[node[leaf]] & 0x7FFFFFFF
        found = np.flatnonzero(length)
        return places[found], length[found], value[found]

    def string(self, value: int) -> bytes:
        return self.strings[value : self.strings.index(b"\0", value)]


class Normaliser:
    def __init__(self, spec: dict[int, int | bytes]):
        self.map = CharacterMap(spec.get(2, b""))
        self.prefix, self.collapse, self.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))

    def _replace(self, data: np.ndarray, offsets: np.ndarray, source: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Apply the character map: bytes, text bounds, and the source of each byte."""
        places = np.flatnonzero((data & 0xC0) != 0x80)
        ends = offsets[np.searchsorted(offsets, places, side="right")]
        at, length, value = self.map.matches(data, places, ends)
        # a rule that covers more than one sign hides the rules that begin within it
        clear = np.ones(len(at), bool)
        crowded = np.flatnonzero(np.r_[at[1:] < (at + length)[:-1], False])
        until = 0
        k = int(crowded[0]) if len(crowded) else len(at)
        while k < len(at):
            if at[k] < until:
                clear[k] = False
                k += 1
                continue
            until = at[k] + length[k]
            k += 1
            if k < len(at) and at[k] >= until:
                more = np.searchsorted(crowded, k)
                k = int(crowded[more]) if more < len(crowded) else len(at)
        at, length, value = at[clear], length[clear], value[clear]
        if not len(at):
            return data, offsets, source
        kinds, kind = np.unique(value, return_inverse=True)
        texts = [self.map.string(int(v)) for v in kinds]
        sizes = np.array([len(t) for t in texts], np.int64)
        store = np.frombuffer(b"".join(texts), np.uint8)
        emits = np.ones(len(data), np.int64)
        emits[gather(at, length)] = 0
        emits[at] = sizes[kind]
        bounds = np.r_[0, np.cumsum(emits)]
        out, origin = np.repeat(data, emits), np.repeat(source, emits)
        out[gather(bounds[at], sizes[kind])] = store[gather((np.cumsum(sizes) - sizes)[kind], sizes[kind])]
        return out, bounds[offsets], origin

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Normalised bytes and text bounds of a block; for each text's bytes, and once more for its end, the source place (``len + 1`` numbers a text)."""
        n = len(offsets) - 1
        source = np.maximum.accumulate(np.where((data & 0xC0) != 0x80, np.arange(len(data), dtype=np.int32), np.int32(0))) if len(data) else np.zeros(0, np.int32)
        out, bounds, origin = self._replace(data, offsets, source) if len(self.map.units) else (data, offsets, source)
        finish = offsets[1:].astype(np.int32)
        if self.collapse:
            blank, first = out == 0x20, np.zeros(len(out) + 1, bool)
            first[bounds[:-1]] = True
            soft = blank.copy()
            if self.escape and len(out) > 2:  # at the end the sign itself counts as a blank too
                sign = np.flatnonzero((out[:-2] == BLANK[0]) & (out[1:-1] == BLANK[1]) & (out[2:] == BLANK[2]))
                soft[gather(sign, np.full(len(sign), 3))] = True
            size = np.diff(bounds)
            wet, dry = np.r_[0, np.cumsum(~soft)], np.r_[0, np.cumsum(~blank)]
            behind = soft & (np.repeat(wet[bounds[1:]], size) == wet[1:])  # nothing else from here on
            before = blank & (np.repeat(dry[bounds[:-1]], size) == dry[1:])  # nothing else up to here
            drop = behind | before | blank & np.r_[False, blank[:-1]] & ~first[:-1]
            tail = np.flatnonzero(behind & (first[:-1] | np.r_[True, ~behind[:-1]]))
            finish[np.searchsorted(bounds, tail, side="right") - 1] = origin[tail]
            kept = np.r_[0, np.cumsum(~drop)]
            out, origin, bounds = out[~drop], origin[~drop], kept[bounds]
        if self.prefix:
            some = np.flatnonzero(np.diff(bounds) > 0)
            begin = bounds[:-1][some]
            # what was dropped at the beginning belongs to no piece
            out, origin = np.insert(out, begin, 0x20), np.insert(origin, begin, origin[begin])
            added = np.zeros(n, np.int64)
            added[some] = 1
            bounds = bounds + np.r_[0, np.cumsum(added)]
        if self.escape:
            blank = out == 0x20
            wide = np.where(blank, 3, 1)
            place = np.r_[0, np.cumsum(wide)]
            at = place[:-1][blank]
            out, origin, bounds = np.repeat(out, wide), np.repeat(origin, wide), place[bounds]
            for k in range(3):
                out[at + k] = BLANK[k]
        origin = np.insert(origin, bounds[1:], finish)
        return out, bounds, origin


class Stretches:
    """Where stretches begin: at each text and at each U+2581 that follows another sign."""

    def __init__(self, within: bool):
        self.within = within  # whether some piece goes over such a place: then texts are whole stretches

    def starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        begins = np.zeros(len(data) + 1, bool)
        begins[offsets[:-1]] = True
        if not self.within and len(data) > 2:
            blank = (data[:-2] == BLANK[0]) & (data[1:-1] == BLANK[1]) & (data[2:] == BLANK[2])
            begins[:-3] |= blank & ~np.r_[False, False, False, blank[:-3]][: len(blank)]
        return np.flatnonzero(begins[:-1])


class PieceBPE(ByteBPE):
    def __init__(self, path: str):
        with open(path, "rb") as f:
            fields = list(message(f.read()))
        pieces = [(d := dict(message(v)))[1].decode() for k, v in fields if k == 1]
        scores = [struct.unpack("<f", d[2])[0] if 2 in d else 0.0 for d in (dict(message(v)) for k, v in fields if k == 1)]
        kinds = [d.get(3, NORMAL) for d in (dict(message(v)) for k, v in fields if k == 1)]
        trainer, normaliser = (dict(message(next((v for k, v in fields if k == field), b""))) for field in (2, 3))
        if trainer.get(3) != 2 or kinds.count(BYTE) != 256 or trainer.get(24) or {USER_DEFINED, UNUSED} & set(kinds):
            raise ValueError("a BPE model with byte pieces is needed, without user-defined or unused pieces")
        self.normalise = Normaliser(normaliser)
        self.pieces_of, self.base = pieces, len(pieces)
        normal = [i for i, k in enumerate(kinds) if k == NORMAL]
        self.byte_ids = np.zeros(256, np.int64)
        self.byte_ids[[int(pieces[i][3:5], 16) for i, k in enumerate(kinds) if k == BYTE]] = [i for i, k in enumerate(kinds) if k == BYTE]
        # symbols: pieces, then letters that only longer pieces have, then one for all other letters
        symbol = {pieces[i]: i for i in normal}
        for i in normal:
            for c in pieces[i]:
                symbol.setdefault(c, len(pieces) + len(symbol))
        names = sorted(set(symbol.values()))
        self.other = max(names) + 1
        self.letters = np.full(0x110000, self.other, np.int64)
        for text, i in symbol.items():
            if len(text) == 1:
                self.letters[ord(text)] = i
        self.width = self.other + 1
        # ranks: pieces by falling score; pieces of one score are told apart by the agenda only
        order = sorted(normal, key=lambda i: (-scores[i], i))
        level = {i: scores[i] for i in normal}
        self.merged = np.array(order, np.int64)
        pairs = [(symbol[pieces[i][:k]] * self.width + symbol[pieces[i][k:]], r) for r, i in enumerate(order) for k in range(1, len(pieces[i])) if pieces[i][:k] in symbol and pieces[i][k:] in symbol]
        keys, ranks = np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64)
        sort = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[sort], ranks[sort]
        self.never = len(order)
        # pieces that others share their score with, and pieces from which one of a better score can be made
        self.tied, self.early = np.zeros(self.never + 1, bool), np.zeros(self.never + 1, bool)
        at = {i: r for r, i in enumerate(order)}
        falling = np.array([scores[i] for i in order])
        self.level = np.r_[np.searchsorted(-falling, -falling), self.never]  # equal scores, equal levels
        made, counts = np.unique(ranks, return_counts=True)
        same = np.bincount(self.level[made], minlength=self.never + 1)
        self.tied[made] = same[self.level[made]] > 1
        for key, r in pairs:
            for part in divmod(key, self.width):
                if part in at and level[part] <= scores[order[r]]:
                    self.early[at[part]] = True
        self.table: dict[int, tuple[int, int]] | None = None
        shown = [b"" if k == CONTROL else trainer.get(44, " ⁇ ".encode()) if k == UNKNOWN else bytes([int(p[3:5], 16)]) if k == BYTE else p.replace("▁", " ").encode() for p, k in zip(pieces, kinds, strict=True)]
        self.shown, self.shown_length = np.frombuffer(b"".join(shown), np.uint8), np.array([*map(len, shown)], np.int64)
        self.shown_at = np.cumsum(self.shown_length) - self.shown_length
        self.blank_first = np.array([k == NORMAL and p.startswith("▁") for p, k in zip(pieces, kinds, strict=True)])
        self.lengths = np.array([1 if k == BYTE else len(p.encode()) for p, k in zip(pieces, kinds, strict=True)], np.int64)
        within = any("▁" in pieces[i].lstrip("▁") for i in normal)
        self.added: dict[str, int] = {}
        self.pieces = Stretches(within)
        self.forget()

    def _pair_ranks(self, symbols: np.ndarray, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.full(len(at), self.never, np.int64)
        inner = np.flatnonzero(at < len(symbols) - 1)
        inner = inner[owner[at[inner]] == owner[at[inner] + 1]]
        wanted = symbols[at[inner]] * self.width + symbols[at[inner] + 1]
        place = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        found = self.keys[place] == wanted
        out[inner[found]] = self.ranks[place[found]]
        return out

    def encode_pieces(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        a = 0
        total = np.r_[0, np.cumsum(lengths)]
        while a < len(starts):
            b = max(a + 1, int(np.searchsorted(total, total[a] + (1 << 18), side="right")) - 1)
            got = self._encode(data[gather(starts[a:b], lengths[a:b])], lengths[a:b])
            ids.append(got[0])
            counts.append(got[1])
            a = b
        return np.concatenate(ids), np.concatenate(counts)

    def _encode(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero((data & 0xC0) != 0x80)
        code = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
        owner = np.repeat(np.arange(len(lengths)), lengths)[at]
        symbols, at, owner = self._merged(self.letters[code], at, owner)
        # letters without a piece: their bytes
        spread = np.ones(len(symbols), np.int64)
        odd = np.flatnonzero(symbols >= self.base)
        first = data[at[odd]]
        spread[odd] = 1 + (first >= 0xC0).astype(np.int64) + (first >= 0xE0) + (first >= 0xF0)
        place = np.cumsum(spread) - spread
        ids = np.repeat(symbols, spread)
        ids[gather(place[odd], spread[odd])] = self.byte_ids[data[gather(at[odd], spread[odd])]]
        counts = np.bincount(np.repeat(owner, spread), minlength=len(lengths))
        return ids.astype(np.int32), counts

    def _merged(self, symbols: np.ndarray, at: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols, their places and owners when nothing more can be merged, by owner and place."""
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        sizes = np.bincount(owner)[owner] if len(owner) else owner
        if (big := sizes > LONG).any():
            done.append(self._by_agenda(symbols[big], at[big], owner[big]))
            symbols, at, owner = symbols[~big], at[~big], owner[~big]
        rank = self._pair_ranks(symbols, owner, np.arange(len(symbols)))
        while len(symbols):
            begins = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.repeat(np.minimum.reduceat(rank, begins), np.diff(np.r_[begins, len(symbols)]))
            over, odd = lowest == self.never, self.tied[lowest]
            if over.any() or odd.any():
                done.append((symbols[over], at[over], owner[over]))
                if odd.any():
                    done.append(self._by_agenda(symbols[odd], at[odd], owner[odd]))
                rest = ~(over | odd)
                symbols, at, owner, rank, lowest = symbols[rest], at[rest], owner[rest], rank[rest], lowest[rest]
                if not len(symbols):
                    break
            chosen = np.flatnonzero(rank == lowest)
            place = np.arange(len(chosen))
            run = np.maximum.accumulate(np.where(np.r_[True, np.diff(chosen) > 1], place, 0))
            chosen = chosen[(place - run) % 2 == 0]  # of overlapping places every second one, from the left
            first = np.r_[True, owner[chosen[1:]] != owner[chosen[:-1]]]
            chosen = chosen[first | ~self.early[lowest[chosen]]]
            symbols[chosen] = self.merged[rank[chosen]]
            keep = np.ones(len(symbols), bool)
            keep[chosen + 1] = False
            symbols, at, owner, rank = symbols[keep], at[keep], owner[keep], rank[keep]
            moved = chosen - np.arange(len(chosen))
            changed = np.unique(np.r_[moved, np.maximum(moved - 1, 0)])
            rank[changed] = self._pair_ranks(symbols, owner, changed)
        if not done:
            return symbols, at, owner
        symbols, at, owner = (np.concatenate([d[i] for d in done]) for i in range(3))
        order = np.lexsort((at, owner))
        return symbols[order], at[order], owner[order]

    def _by_agenda(self, symbols: np.ndarray, at: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One merge at a time: the best score first, the leftmost of equals. Owners never merge with each other, so one agenda serves all."""
        if self.table is None:
            self.table = dict(zip(self.keys.tolist(), zip(self.level[self.ranks].tolist(), self.merged[self.ranks].tolist(), strict=True), strict=True))
        known, width, n = self.table, self.width, len(symbols)
        now, own = symbols.tolist(), owner.tolist()
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))

        def pair(i: int) -> tuple[int, int] | None:
            j = after[i]
            return known.get(now[i] * width + now[j]) if j < n and own[i] == own[j] else None

        agenda = [p[0] << 40 | i for i in range(n) if (p := pair(i))]
        heapq.heapify(agenda)
        while agenda:
            top = heapq.heappop(agenda)
            i = top & (1 << 40) - 1
            if now[i] < 0 or not (p := pair(i)) or p[0] != top >> 40:
                continue
            j = after[i]
            now[i], now[j] = p[1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for x in (before[i], i):
                if x >= 0 and (p := pair(x)):
                    heapq.heappush(agenda, p[0] << 40 | x)
        left = np.array(now, np.int64)
        kept = left >= 0
        return left[kept], at[kept], owner[kept]

    def encode_texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a block's texts, their bounds, and each id's span of source bytes within its text."""
        norm, norm_offsets, origin = self.normalise(data, offsets)
        ids, counts = self.encode_block(norm, norm_offsets) if len(norm) else (np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64))
        bounds = np.r_[0, np.cumsum(counts)]
        text = np.repeat(np.arange(len(counts)), counts)
        end = np.cumsum(self.lengths[ids])  # normalised bytes up to each id; a text has one more place than bytes
        base = offsets[:-1][text]
        return ids, bounds, origin[end - self.lengths[ids] + text] - base, origin[end + text] - base

    def decode_texts(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of the texts of ids, and their bounds."""
        ids = np.where((ids >= 0) & (ids < self.base), ids, -1)
        size = np.where(ids >= 0, self.shown_length[ids], 0)
        place = np.r_[0, np.cumsum(size)]
        data = self.shown[gather(np.where(ids >= 0, self.shown_at[ids], 0), size)]
        cuts = place[bounds]
        keep = np.ones(len(data), bool)
        if self.normalise.prefix or self.normalise.collapse:
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                while a < b and (not size[a] or self.blank_first[ids[a]]):
                    if size[a]:
                        keep[place[a]] = False
                        if size[a] > 1 or not self.normalise.collapse:
                            break
                    a += 1
        if not keep.all():
            data, cuts = data[keep], np.r_[0, np.cumsum(keep)][cuts]
        return data, cuts


def _shown(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Texts as a string column; bytes that are no UTF-8 become U+FFFD one by one."""
    raw = data.tobytes()
    try:
        raw.decode()
    except UnicodeDecodeError:
        texts = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            part, out = raw[a:b], []
            while part:
                try:
                    out.append(part.decode())
                    break
                except UnicodeDecodeError as e:
                    out.append(part[: e.start].decode() + "�")
                    part = part[e.start + 1 :]
            texts.append("".join(out))
        return pa.array(texts, pa.string())
    return pa.Array.from_buffers(pa.large_string(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(raw)]).cast(pa.string())


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.astype(np.int32)))


def encode(df: DataFrame, text: str = "text", model: str | None = None) -> DataFrame:
    """``df`` with array columns ``ids``, ``starts`` and ``ends``: pieces of ``text`` and their spans of its UTF-8 bytes (end exclusive)."""
    from pyspark.sql.types import ArrayType, IntegerType, StructType

    names = ["ids", "starts", "ends"]
    df, path = df.drop(*names), model or default_model()

    def run(batches):
        bpe = loaded(path, PieceBPE)
        for batch in batches:
            for at, data, offsets in text_blocks(batch.column(batch.schema.get_field_index(text)), BLOCK_BYTES):
                ids, bounds, starts, ends = bpe.encode_texts(data, offsets)
                rows = batch.slice(at, len(offsets) - 1)
                yield pa.RecordBatch.from_arrays([*rows.columns, *(_lists(x, bounds) for x in (ids, starts, ends))], names=[*rows.schema.names, *names])

    schema = StructType([*df.schema.fields])
    for name in names:
        schema = schema.add(name, ArrayType(IntegerType(), False))
    return df.mapInArrow(run, schema)


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", model: str | None = None) -> DataFrame:
    """``df`` with ``out``: the text of the array column ``ids`` (null counts as empty)."""
    from pyspark.sql.types import StringType, StructType

    df, path = df.drop(out), model or default_model()

    def run(batches):
        bpe = loaded(path, PieceBPE)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            for a in range(0, max(batch.num_rows, 1), 256):
                rows, lists = batch.slice(a, 256), column.slice(a, 256)
                counts = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
                values = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([*rows.columns, _shown(*bpe.decode_texts(values, np.r_[0, np.cumsum(counts)]))], names=[*rows.schema.names, out])

    return df.mapInArrow(run, StructType([*df.schema.fields]).add(out, StringType()))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    slim = pieces.select("doc_id", "ids", F.xxhash64("starts", "ends").alias("spans_hash"))
    return decode(slim).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "spans_hash")
