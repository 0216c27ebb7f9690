"""Subword encoding with seeded merge-dropout, and lossless decoding, over a sentencepiece BPE model (operator 1).

Encoding follows the model's own agenda: adjacent symbols whose join is a piece are merged, the best score first, leftmost among
equals. With dropout each candidate merge that comes up is skipped if a hash keyed by the seed falls below the rate, so words are
segmented in various ways, the same on each run. A skipped candidate stays out until a neighbour changes. Rate 0 gives the
model's plain segmentation.

No merge crosses a newline, a run of blanks' start, or a mark after a letter where no piece does, so a text is encoded by units.
Each occurrence of a unit in a document has draws of its own, from a generator keyed by seed and document: a bit for each candidate
merge as it comes up, set with the rate's probability. Segmentations are kept by unit and the bits that were asked for, which changes
nothing in them; those that aren't kept are worked out many at a time, in arrays. Units of more than SHORT symbols hash their candidates
under a key of the occurrence instead.

Characters that no piece has become their bytes' pieces, and so does a literal U+2581, which pieces use for the blank:
decoding gives back the exact text. A null text has no ids (null) and decodes to null; the empty text has none and decodes to itself.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
import sys
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellon.llm import common

BLANK = "▁"
#: A unit of so many symbols has at most 63 candidate merges: each pair once, and two new ones after each merge.
SHORT = 22
KEPT = 200_000
#: Occurrences whose segmentations are worked out at once.
TOGETHER = 1 << 15
RATE = 0.1
SEED = 20_24
_MASK, _NEVER = (1 << 64) - 1, 1 << 60
_ID_BITS = 20
_ID_MASK = (1 << _ID_BITS) - 1


def public_model(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceModel:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        normal, trainer = spec.normalizer_spec, spec.trainer_spec
        if trainer.model_type != 2 or not trainer.byte_fallback or normal.precompiled_charsmap or normal.remove_extra_whitespaces or trainer.treat_whitespace_as_suffix:
            raise ValueError("a BPE model with byte fallback and no normalisation is needed; others aren't lossless")
        self.prefix = " " if normal.add_dummy_prefix else ""
        self.piece: dict[str, int] = {}
        scores: dict[str, float] = {}
        self.of_byte = [0] * 256
        self.bytes_of = [b""] * len(spec.pieces)
        for i, p in enumerate(spec.pieces):
            if p.type == 6:
                value = int(p.piece[3:5], 16)
                self.of_byte[value], self.bytes_of[i] = i, bytes([value])
            elif p.type == 1:
                self.piece[p.piece], scores[p.piece] = i, p.score
                self.bytes_of[i] = p.piece.replace(BLANK, " ").encode()
        order = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = {p: order[s] for p, s in scores.items()}  # 0 is merged first
        # symbols by number: pieces have theirs, characters that occur in pieces alone the next ones; any other character has the last
        # number and takes part in no merge. Pairs that are a piece have its rank and number, which gives the
        # agenda's order where ranks differ: only runs of blanks may have equal ones.
        number = dict(self.piece)
        for c in sorted({c for p in self.piece for c in p} - set(number)):
            number[c] = len(self.bytes_of) + len(number) - len(self.piece)
        self.single = {c: i for c, i in number.items() if len(c) == 1}
        self.lone, self.alone = _ID_MASK, {i: c for c, i in self.single.items() if i >= len(self.bytes_of)}
        self.pairs: dict[int, int] | None = None
        ranked = Counter(self.rank[p] for p in self.piece if len(p) > 1)
        tied = {p for p in self.piece if len(p) > 1 and ranked[self.rank[p]] > 1}
        if not any(p.strip(BLANK) for p in tied) and len(self.bytes_of) + len(number) < _ID_MASK:
            self.pairs = {}
            for p, i in self.piece.items():
                value = self.rank[p] << _ID_BITS | i
                for k in range(1, len(p)):
                    left, right = number.get(p[:k]), number.get(p[k:])
                    if left is not None and right is not None:
                        self.pairs[left << _ID_BITS | right] = value
        if any(BLANK in p.lstrip(BLANK) for p in self.piece):
            raise ValueError("pieces that go over a blank aren't supported")
        marks = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
        after_letter = {b for p in self.piece for a, b in zip(p, p[1:], strict=False) if a.isalpha()}
        closing = re.escape("".join(c for c in marks if c not in after_letter))
        over_lines = any("\n" in p for p in self.piece)
        line = "" if over_lines else r"\n"
        letter = r"[^\W\d_]"
        self.units = re.compile(
            rf" *{letter}+(?:[^ {line}{BLANK}{closing}\w][^ {line}{BLANK}]*|[\d_][^ {line}{BLANK}]*)?| *[^ {line}{BLANK}][^ {line}{BLANK}]*| +|\n|{BLANK}"
        ).findall

    def segment(self, unit: str, rate: float = 0.0, key: int = 0) -> list[int]:
        """Ids of one unit."""
        if unit == BLANK:
            return [self.of_byte[b] for b in unit.encode()]
        symbols = list(unit.replace(" ", BLANK))
        limit = int(rate * (1 << 64))
        base = xxhash.xxh3_64_intdigest(unit, seed=key & _MASK) if limit else 0
        return self._ids((self._merge_short if len(symbols) <= 48 else self._merge_long)(symbols, limit, base))

    def _ids(self, symbols: list[str]) -> list[int]:
        out = []
        for s in symbols:
            got = self.piece.get(s)
            if got is None:
                out += [self.of_byte[x] for x in s.encode()]
            else:
                out.append(got)
        return out

    @staticmethod
    def _skipped(base: int, left: int, rank: int, limit: int) -> bool:
        h = ((base ^ (left * 0x9E3779B97F4A7C15 + rank * 0xC2B2AE3D27D4EB4F)) * 0xBF58476D1CE4E5B9) & _MASK
        return h ^ (h >> 31) < limit

    def _merge_short(self, symbols: list[str], limit: int, base: int) -> list[str]:
        """The agenda as a list of ranks by place: for the few symbols of a word, scanning beats a heap."""
        get = self.rank.get
        ranks = [get(a + b, _NEVER) for a, b in zip(symbols, symbols[1:], strict=False)]
        places = list(range(len(symbols)))  # where each symbol began
        while ranks:
            rank = min(ranks)
            if rank == _NEVER:
                break
            k = ranks.index(rank)
            if limit:  # _skipped(), in place for speed
                h = ((base ^ (places[k] * 0x9E3779B97F4A7C15 + rank * 0xC2B2AE3D27D4EB4F)) * 0xBF58476D1CE4E5B9) & _MASK
                if h ^ (h >> 31) < limit:
                    ranks[k] = _NEVER
                    continue
            joined = symbols[k] = symbols[k] + symbols.pop(k + 1)
            del ranks[k], places[k + 1]
            if k < len(ranks):
                ranks[k] = get(joined + symbols[k + 1], _NEVER)
            if k:
                ranks[k - 1] = get(symbols[k - 1] + joined, _NEVER)
        return symbols

    def _merge_drawn(self, symbols: list[str], draw: int) -> tuple[list[str], int]:
        """The same agenda, where the bits of draw say from the lowest on which candidates are skipped; and how many came up."""
        get, asked = self.rank.get, 0
        ranks = [get(a + b, _NEVER) for a, b in zip(symbols, symbols[1:], strict=False)]
        while ranks:
            rank = min(ranks)
            if rank == _NEVER:
                break
            k = ranks.index(rank)
            skipped = draw >> asked & 1
            asked += 1
            if skipped:
                ranks[k] = _NEVER
                continue
            joined = symbols[k] = symbols[k] + symbols.pop(k + 1)
            del ranks[k]
            if k < len(ranks):
                ranks[k] = get(joined + symbols[k + 1], _NEVER)
            if k:
                ranks[k - 1] = get(symbols[k - 1] + joined, _NEVER)
        return symbols, asked

    def drawn(self, unit: str, draw: int) -> tuple[list[int], int]:
        """Ids of a short unit, where the bits of draw say from the lowest on which candidates are skipped; and how many came up."""
        text = unit.replace(" ", BLANK)
        if self.pairs is None or "  " in unit:
            symbols, asked = self._merge_drawn(list(text), draw)
            return self._ids(symbols), asked
        lone, single, get = self.lone, self.single, self.pairs.get
        symbols = [single.get(c, lone) for c in text]
        spare = [c for c, i in zip(text, symbols, strict=True) if i == lone]
        ranks = [get(a << _ID_BITS | b, _NEVER) for a, b in zip(symbols, symbols[1:])]  # noqa: B905
        asked = 0
        while ranks:
            rank = min(ranks)
            if rank == _NEVER:
                break
            k = ranks.index(rank)
            asked += 1
            if draw & 1:
                ranks[k] = _NEVER
                draw >>= 1
                continue
            draw >>= 1
            joined = symbols[k] = rank & _ID_MASK
            del symbols[k + 1], ranks[k]
            if k < len(ranks):
                ranks[k] = get(joined << _ID_BITS | symbols[k + 1], _NEVER)
            if k:
                ranks[k - 1] = get(symbols[k - 1] << _ID_BITS | joined, _NEVER)
        if max(symbols) < len(self.bytes_of):
            return symbols, asked
        out, rest = [], iter(spare)
        for i in symbols:
            out += [i] if i < len(self.bytes_of) else self._ids([next(rest) if i == lone else self.alone[i]])
        return out, asked

    def _merge_long(self, given: list[str], limit: int, base: int) -> list[str]:
        """The same agenda as a heap, for units of any length."""
        symbols: list[str | None] = list(given)
        n, get = len(symbols), self.rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(r, k, symbols[k] + symbols[k + 1]) for k in range(n - 1) if (r := get(symbols[k] + symbols[k + 1])) is not None]
        heapq.heapify(agenda)
        while agenda:
            rank, left, joined = heapq.heappop(agenda)
            right = after[left]
            if symbols[left] is None or right >= n or symbols[left] + symbols[right] != joined:
                continue
            if limit and self._skipped(base, left, rank, limit):
                continue
            symbols[left], symbols[right] = joined, None
            onward = after[left] = after[right]
            if onward < n:
                before[onward] = left
                if (r := get(joined + symbols[onward])) is not None:
                    heapq.heappush(agenda, (r, left, joined + symbols[onward]))
            back = before[left]
            if back >= 0 and (r := get(symbols[back] + joined)) is not None:
                heapq.heappush(agenda, (r, back, symbols[back] + joined))
        return [s for s in symbols if s is not None]

    def decode(self, ids) -> str:
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode()
        return text[len(self.prefix) :] if text else text


class Agenda:
    """The agendas of many short units at once: place by place arrays with a column for each unit."""

    PLACE_BITS = 5  # a unit has at most SHORT places
    CHUNK = 8192

    def __init__(self, model: PieceModel):
        self.pieces, self.lone = len(model.bytes_of), model.lone
        pairs = np.array(list(model.pairs), np.uint64)
        values = np.array(list(model.pairs.values()), np.int64)
        # pairs by slot of a table: those of a slot lie side by side
        self.bits = max(8, len(pairs).bit_length() + 2)
        slots = self._slot(pairs)
        order = np.argsort(slots, kind="stable")
        many = np.bincount(slots, minlength=1 << self.bits)
        self.start, self.most = (np.cumsum(many) - many).astype(np.int32), int(many.max(initial=0))
        self.many = many.astype(np.uint8)
        self.keys = np.append(pairs[order], np.uint64(_MASK))
        values = values[order]
        # rank, place (0 as yet) and piece, so that the least one is the leftmost of the best
        self.values = np.append((values >> _ID_BITS) << (_ID_BITS + self.PLACE_BITS) | (values & _ID_MASK), _NEVER)
        self.single = np.full(sys.maxunicode + 1, self.lone, np.int32)
        for c, i in model.single.items():
            self.single[ord(c)] = i

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """What pairs of symbols merge to, by rank and piece; _NEVER for pairs that are no piece."""
        keys = (left.astype(np.int64) << _ID_BITS | right).view(np.uint64)
        slot = self._slot(keys)
        at = self.start[slot]
        hit = self.keys[at] == keys
        out = np.where(hit, self.values[at], _NEVER)
        rest = np.flatnonzero(~hit & (self.many[slot] > 1))
        for k in range(1, self.most):
            if not len(rest):
                break
            more = at[rest] + k
            hit = self.keys[more] == keys[rest]
            out[rest[hit]] = self.values[more[hit]]
            rest = rest[~hit & (self.many[slot[rest]] > k + 1)]
        return out

    def run(self, units: list[str], draws: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The symbols of the units, laid end to end, how many each has, and how many candidates came up; the bits of a draw say from the lowest
        on which candidates are skipped."""
        size = np.fromiter(map(len, units), np.int64, len(units))
        points = np.frombuffer("".join(units).replace(" ", BLANK).encode("utf-32-le"), "<u4")
        symbols, begins = self.single[points], np.cumsum(size) - size
        order = np.argsort(size, kind="stable")
        final = np.full((int(size.max(initial=1)), len(units)), -1, np.int32)
        asked = np.zeros(len(units), np.int64)
        for a in range(0, len(units), self.CHUNK):
            mine = order[a : a + self.CHUNK]
            self._chunk(symbols, begins[mine], size[mine], draws[mine], mine, final, asked)
        flat = final.T.ravel()
        return flat[flat >= 0], (final >= 0).sum(0), asked

    def _chunk(self, symbols, begins, size, draw, which, final, asked) -> None:
        n, places = len(size), int(size[-1])
        row = np.arange(places)[:, None]
        inside = row < size
        sym = np.full((places + 1, n), self.lone, np.int32)  # the last row stands for what is before and after a unit
        sym[:places] = np.where(inside, symbols[np.minimum(begins + row, len(symbols) - 1)], -1)
        after = np.empty((places + 1, n), np.int64)
        after[:places] = np.where(row + 1 < size, row + 1, places)
        before = np.empty((places + 1, n), np.int64)
        before[:places] = np.where(row > 0, row - 1, places)
        rank = np.full((places + 1, n), _NEVER, np.int64)
        pair = row + 1 < size
        rank[:places][pair] = self.joined(sym[:places][pair], sym[1:][pair]) | np.broadcast_to(row, pair.shape)[pair] << _ID_BITS
        draw, count = draw.copy(), np.zeros(n, np.int64)
        while True:
            best = rank[:places].min(0)
            live = best < _NEVER
            cols = np.flatnonzero(live)
            if 4 * len(cols) < 3 * n or not len(cols):
                done = np.flatnonzero(~live)
                final[:places, which[done]], asked[which[done]] = sym[:places, done], count[done]
                if not len(cols):
                    return
                sym, after, before, rank = (x.take(cols, 1) for x in (sym, after, before, rank))
                draw, count, which, best = draw[cols], count[cols], which[cols], best[cols]
                n = len(cols)
                cols = np.arange(n)
            flat_sym, flat_after, flat_before, flat_rank = (x.reshape(-1) for x in (sym, after, before, rank))
            got = best[cols]
            place = got >> _ID_BITS & ((1 << self.PLACE_BITS) - 1)
            at = place * n + cols
            flat_rank[at] = _NEVER
            count[cols] += 1
            go = np.flatnonzero((draw[cols] & np.uint64(1)) == 0)
            draw >>= np.uint64(1)
            cols, place, at, piece = cols[go], place[go], at[go], got[go] & _ID_MASK
            right = flat_after[at] * n + cols
            onward = flat_after[right]
            flat_sym[at], flat_sym[right], flat_rank[right], flat_after[at] = piece, -1, _NEVER, onward
            flat_before[onward * n + cols] = place
            flat_rank[at] = self.joined(piece, flat_sym[onward * n + cols]) | place << _ID_BITS
            back = flat_before[at]
            flat_rank[back * n + cols] = self.joined(flat_sym[back * n + cols], piece) | back << _ID_BITS


_LONG = 1 << 63  # the bit that is set in every draw


def make_room(kept: dict, bound: int) -> None:
    """Drops the older half of a full memory."""
    if len(kept) >= bound:
        for key in list(islice(kept, bound // 2)):
            del kept[key]


class Plain(dict):
    """unit -> its plain ids as bytes, and the bits of a draw that must be 0 for them."""

    def __init__(self, model: PieceModel, dtype: str, bound: int):
        super().__init__()
        self.model, self.bound = model, bound
        self.code = {"<u2": "H", "<u4": "I"}[dtype]

    def packed(self, ids: list[int]) -> bytes:
        out = array(self.code, ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def keep(self, unit: str, got: tuple[bytes, int]) -> None:
        make_room(self, self.bound)
        self[unit] = got

    def __missing__(self, unit: str) -> tuple[bytes, int]:
        if unit == BLANK:
            got = self.packed(self.model.segment(unit)), 0
        elif len(unit) > SHORT:
            got = self.packed(self.model.segment(unit)), _LONG
        else:
            ids, asked = self.model.drawn(unit, 0)
            got = self.packed(ids), (1 << asked) - 1
        self.keep(unit, got)
        return got


class Encoder:
    """kept: how many segmentations are held in memory; it has no bearing on the ids."""

    def __init__(self, path: str, rate: float, seed: int, kept: int = KEPT):
        self.model = PieceModel(path)
        self.dtype = "<u2" if len(self.model.bytes_of) <= 1 << 16 else "<u4"
        self.plain = Plain(self.model, self.dtype, kept)
        self.known: dict[tuple[str, int, int], bytes | int] = {}
        self.agenda = Agenda(self.model) if rate and self.model.pairs is not None else None
        self.rate, self.seed, self.kept = rate, seed & _MASK, kept
        # the rate as a binary fraction, to a relative 2**-17 or better
        digits = 16 + max(0, math.ceil(-math.log2(rate))) if rate else 0
        q = min(round(rate * (1 << digits)), 1 << digits)
        self.always = bool(digits) and q == 1 << digits
        self.digits = [q >> k & 1 for k in range(digits)]
        while self.digits and not self.digits[0]:
            self.digits.pop(0)

    def draws(self, key: str, n: int, block: int = 1 << 15) -> Iterator[int]:
        """A number for each of n occurrences in a document: bits 0 to 62 are set with the rate's probability each, bit 63 always."""
        source = np.random.SFC64([xxhash.xxh3_64_intdigest(key, seed=self.seed), self.seed])
        for at in range(0, n, block):
            m = min(block, n - at)
            out = np.full(m, _MASK if self.always else 0, np.uint64)
            if not self.always:
                for digit, raw in zip(self.digits, source.random_raw(m * len(self.digits)).reshape(len(self.digits), m), strict=True):
                    out = out | raw if digit else out & raw
            yield from (out | np.uint64(_LONG)).tolist()

    def dropped(self, unit: str, draw: int, mask: int, key: str, place: int) -> bytes:
        """Ids of one occurrence for which some candidate is skipped."""
        got = mask if mask == _LONG else self.known.get((unit, draw & mask, mask))
        while type(got) is int and got != _LONG:
            mask = got
            got = self.known.get((unit, draw & mask, mask))
        return got if type(got) is bytes else self.single(unit, draw, mask, key, place)

    def single(self, unit: str, draw: int, mask: int, key: str, place: int) -> bytes:
        """Ids of an occurrence that isn't kept and not worked out with others."""
        if mask == _LONG:
            own = xxhash.xxh3_64_intdigest(f"{key}/{place}", seed=self.seed)
            return self.plain.packed(self.model.segment(unit, self.rate, own))
        ids, asked = self.model.drawn(unit, draw)
        return self.keep(unit, draw, mask, self.plain.packed(ids), (1 << asked) - 1)

    def keep(self, unit: str, draw: int, mask: int, ids: bytes, wide: int) -> bytes:
        """Keeps a segmentation under the bits that were asked for (wide); where the plain one's, or a kept mask, are too few, the wider mask is
        kept in the place of ids. mask -1: the plain segmentation isn't kept yet."""
        if mask < 0:
            if not draw & wide:
                self.plain.keep(unit, (ids, wide))
            return ids
        known = self.known
        make_room(known, self.kept)
        if wide > mask:
            known[unit, draw & mask, mask] = wide
            mask = wide
        known[unit, draw & mask, mask] = ids
        return ids

    def together(self, out: list, pending: list[tuple[int, str, int, int]]) -> None:
        """Works out pending occurrences (place in out, unit, draw, mask) at once."""
        if not pending:
            return
        if self.agenda is None:
            for at, unit, draw, mask in pending:
                out[at] = self.single(unit, draw, mask, "", 0)
        else:
            flat, many, asked = self.agenda.run([p[1] for p in pending], np.array([p[2] for p in pending], np.uint64))
            ends = np.cumsum(many)
            other = np.zeros(len(flat) + 1, np.int64)
            np.cumsum(flat >= self.agenda.pieces, out=other[1:])  # symbols that are no pieces become bytes one by one
            plain = (other[ends] == other[ends - many]).tolist()
            size = np.dtype(self.dtype).itemsize
            packed, ends = flat.astype(self.dtype).tobytes(), (ends * size).tolist()
            begin = 0
            for (at, unit, draw, mask), end, count, ok in zip(pending, ends, asked.tolist(), plain, strict=True):
                out[at] = self.keep(unit, draw, mask, packed[begin:end], (1 << count) - 1) if ok else self.single(unit, draw, mask, "", 0)
                begin = end
        pending.clear()

    def encode_all(self, texts: list[str | None], keys: list[str]) -> list[bytes | None]:
        """Ids of each text as little-endian bytes; none for null."""
        plain, known = self.plain, self.known
        out: list[bytes] = []
        ends, pending = [], []
        for text, key in zip(texts, keys, strict=True):
            units = self.model.units(self.model.prefix + text) if text else []
            if not self.rate:
                out += [plain[u][0] for u in units]
                ends.append(len(out))
                continue
            begin = len(out)
            for unit, draw in zip(units, self.draws(key, len(units)), strict=True):
                got = plain.get(unit)
                if got is None:
                    if unit != BLANK and len(unit) <= SHORT:
                        pending.append((len(out), unit, draw, -1))
                        out.append(b"")
                        if len(pending) >= TOGETHER:
                            self.together(out, pending)
                        continue
                    got = plain[unit]
                ids, mask = got
                if draw & mask:
                    if mask == _LONG:
                        out.append(self.dropped(unit, draw, mask, key, len(out) - begin))
                        continue
                    ids = known.get((unit, draw & mask, mask))
                    while type(ids) is int:
                        mask = ids
                        ids = known.get((unit, draw & mask, mask))
                    if ids is None:
                        pending.append((len(out), unit, draw, mask))
                        out.append(b"")
                        if len(pending) >= TOGETHER:
                            self.together(out, pending)
                        continue
                out.append(ids)
            ends.append(len(out))
        self.together(out, pending)
        return [None if t is None else b"".join(out[a:b]) for t, a, b in zip(texts, [0, *ends], ends, strict=False)]

    def encode(self, text: str, key: str = "") -> bytes:
        return self.encode_all([text], [key])[0]


@lru_cache(maxsize=1)
def encoder(path: str, rate: float, seed: int, kept: int = KEPT) -> Encoder:
    """One for each Python worker."""
    return Encoder(path, rate, seed, kept)


common.cache("pieces", encoder.cache_clear)


def _batches(batches: Iterator[pa.RecordBatch], args):
    common.use_only("pieces")
    coder = encoder(*args)
    for batch in batches:
        for part in common.slices(batch, "text"):
            texts = common.pylist(part, "text")
            got = coder.encode_all(texts, common.pylist(part, "key"))
            yield coder, part, texts, [None if g is None else np.frombuffer(g, coder.dtype) for g in got]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), key.alias("key"), F.col(text_col).cast("string").alias("text"))


def encode(docs: DataFrame, model_path: str, rate: float = RATE, seed: int = SEED, kept: int = KEPT, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, n_pieces and ids (array of int) of every whole text."""
    args = (model_path, rate, seed, kept)

    def run(batches):
        for _, part, _, ids in _batches(batches, args):
            size = np.array([0 if i is None else len(i) for i in ids], np.int64)
            offsets = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32), mask=np.array([*(i is None for i in ids), False]))
            values = pa.array(np.concatenate([np.empty(0, np.int32), *(i for i in ids if i is not None)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size), pa.ListArray.from_arrays(offsets, values)], ["doc_id", "n_pieces", "ids"])

    return _keyed(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_pieces long, ids array<int>")


def decode(encoded: DataFrame, model_path: str, id_col="doc_id", ids_col="ids") -> DataFrame:
    """doc_id and text of encoded documents."""

    def run(batches):
        model = encoder(model_path, 0.0, 0).model
        for batch in batches:
            texts = [None if i is None else model.decode(i) for i in common.pylist(batch, "ids")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model_path: str, rate: float = RATE, seed: int = SEED, kept: int = KEPT, id_col="doc_id", text_col="text") -> DataFrame:
    """Encodes and decodes every whole text: n_pieces, ids_crc32 (of the ids as little-endian unsigned 32-bit), the
    decoded text's sha256, and whether it is the text."""
    args = (model_path, rate, seed, kept)

    def run(batches):
        for coder, part, texts, ids in _batches(batches, args):
            back = [None if i is None else coder.model.decode(i.tolist()) for i in ids]
            yield pa.RecordBatch.from_arrays([
                part.column(0), pa.array([0 if i is None else len(i) for i in ids], pa.int64()),
                pa.array([None if i is None else zlib.crc32(i.astype("<u4").tobytes()) for i in ids], pa.int64()),
                pa.array([None if b is None else hashlib.sha256(b.encode()).hexdigest() for b in back], pa.string()),
                pa.array([a == b for a, b in zip(texts, back, strict=True)], pa.bool_()),
            ], ["doc_id", "n_pieces", "ids_crc32", "decoded_sha256", "lossless"])

    return _keyed(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string, lossless boolean")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(common.table(spark, sf_dir, "documents").select("doc_id", "text"), public_model())
