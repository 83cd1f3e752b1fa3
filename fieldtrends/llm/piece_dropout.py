"""SentencePiece BPE encoding with seeded merge-dropout, and lossless decoding.

The merge table of a public model is applied by an agenda: candidate merges of neighbouring symbols are taken
by score, then from left to right, and each candidate is skipped with a given probability. Whether the k-th
candidate of a unit is skipped depends on a hash of (seed, document, place of the unit, k) only, so the same
seed gives the same segmentation on any cluster, and another seed another one. Skipped candidates are lost, as
in the public library, but the pieces always spell the same text.

A unit is a run of spaces with the characters after it, or a line break; no piece of the model reaches from one
unit into the next (checked when the model is loaded). The agendas of many units run side by side, one
candidate of each per step, and equal units with equal draws of a batch are merged once; both change the speed only.
"""

from __future__ import annotations

import heapq
import re
import zlib
from functools import lru_cache

from pyspark.sql import DataFrame, functions as F

from fieldtrends.llm.common import map_batches, text_or_empty

SPACE = "▁"
UNIT = re.compile(" +[^ \n]*|[^ \n]+|\n")
NORMAL, BYTE = 1, 6
LANES = 24  # candidates whose draws are made at once and agendas run side by side; longer agendas run alone
LONGEST = 24  # characters of a unit that runs side by side with others
#: A unit of n characters rarely offers more than SPAN[n] candidates; that many draws are made at once, and
#: a unit that does offer more runs alone.
SPAN = [min(LANES, n + 3) for n in range(LONGEST + 1)]
ROWS = 8_000  # units side by side
AT_ONCE = 4_000_000  # bytes of text whose units are interned together
MASK = (1 << 64) - 1


def mix(x: int) -> int:
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & MASK
    return x ^ (x >> 31)


class Pieces:
    """Vocabulary of a BPE model with byte fallback."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or spec.name != "identity" or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("needs a BPE model that leaves texts as they are and adds a leading space")
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.scores = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.bytes = [0] * 256
        for i, p in enumerate(model.pieces):
            if p.type == BYTE:
                self.bytes[int(p.piece[3:-1], 16)] = i
        if any(re.search(f"[^{SPACE}]{SPACE}|\n|\0", p) for p in self.ids):
            raise ValueError("a piece of this model reaches over a word start or a line break")
        self.flat = None
        self.spelled = {i: p.replace(SPACE, " ").encode() for p, i in self.ids.items()}
        self.spelled.update({i: bytes([b]) for b, i in enumerate(self.bytes)})

    def spell(self, symbol: str) -> list[int]:
        """Ids of a symbol that is merged no further; what the vocabulary lacks, and a literal space sign, as bytes."""
        if symbol in self.ids:
            return [self.ids[symbol]]
        return [self.bytes[b] for b in symbol.replace("\0", SPACE).encode()]

    def decode_many(self, ids, stops) -> list[str]:
        """Texts of many documents: all ids in one array, and where each document ends."""
        import numpy as np

        if self.flat is None:
            parts = [self.spelled.get(i, b"") for i in range(max(self.spelled) + 1)]
            self.length = np.array([len(p) for p in parts], dtype=np.int64)
            self.begin = np.cumsum(self.length) - self.length
            self.flat = np.frombuffer(b"".join(parts), dtype=np.uint8)
        size = self.length[ids]
        ends = np.cumsum(size)
        place = np.repeat(self.begin[ids] - ends + size, size) + np.arange(int(size.sum()))
        raw = self.flat[place].tobytes()
        cut = np.concatenate(([0], ends))[np.concatenate(([0], stops))].tolist()
        texts = [raw[a:z].decode() for a, z in zip(cut[:-1], cut[1:])]
        return [t[1:] if t.startswith(" ") else t for t in texts]

    def decode(self, ids) -> str:
        text = b"".join(map(self.spelled.__getitem__, ids)).decode()
        return text[1:] if text.startswith(" ") else text


def merge(unit: str, pieces: Pieces, skip) -> tuple[list[int], int]:
    """Ids of one unit and the number of candidates taken from the agenda; ``skip(k)`` says whether the k-th is skipped."""
    symbols: list[str | None] = list(unit)
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    scores = pieces.scores
    agenda = []

    def propose(a: int, b: int) -> None:
        if a >= 0 and b < n:
            both = symbols[a] + symbols[b]
            if both in scores:
                heapq.heappush(agenda, (-scores[both], a, both))

    for i in range(n - 1):
        propose(i, i + 1)
    taken = 0
    while agenda:
        _, a, both = heapq.heappop(agenda)
        if symbols[a] is None or (b := after[a]) >= n or symbols[a] + symbols[b] != both:
            continue  # one of its symbols has been merged with another since
        taken += 1
        if skip(taken - 1):
            continue
        symbols[a], symbols[b] = both, None
        after[a] = after[b]
        if after[a] < n:
            before[after[a]] = a
        propose(before[a], a)
        propose(a, after[a])
    return [i for s in symbols if s is not None for i in pieces.spell(s)], taken


class SideBySide:
    """``merge`` for many units at once: a row of symbols per unit, and in each step the best pair of every row."""

    def __init__(self, pieces: Pieces):
        import numpy as np

        self.vocabulary = len(pieces.spelled) + 3
        singles = {p for p in pieces.ids if len(p) == 1} | {c for p in pieces.ids for c in p}
        number = pieces.ids | {c: self.vocabulary + i for i, c in enumerate(sorted(singles - pieces.ids.keys()))}
        self.width = self.vocabulary + len(number)
        self.of_char = np.full(0x110000, -1, dtype=np.int32)
        for c in singles:
            self.of_char[ord(c)] = number[c]
        pairs = {
            number[p[:k]] * self.width + number[p[k:]]: (i, pieces.scores[p])
            for p, i in pieces.ids.items() for k in range(1, len(p)) if p[:k] in number and p[k:] in number
        }
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.ids = np.array([pairs[k][0] for k in self.keys.tolist()], dtype=np.int32)
        self.scores = np.array([pairs[k][1] for k in self.keys.tolist()], dtype=np.float32)

    def pair(self, a, b):
        import numpy as np

        key = a.astype(np.int64) * self.width + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (a >= 0) & (b >= 0)
        return np.where(hit, self.ids[at], -1), np.where(hit, self.scores[at], np.float32(-np.inf))

    def merge(self, units: list[str], patterns):
        """Ids of all units one after the other, the number of ids of each, whether it has to run alone, and the candidates taken."""
        import numpy as np

        size = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        wide = int(size.max()) + 1  # the last column is empty
        rows, cols = np.repeat(np.arange(len(units)), size), np.arange(wide)
        symbols = np.full((len(units), wide), -1, dtype=np.int32)
        inner = np.arange(len(rows)) - np.repeat(np.cumsum(size) - size, size)
        symbols[rows, inner] = self.of_char[np.frombuffer("".join(units).encode("utf-32-le"), dtype="<u4")]
        alone = np.zeros(len(units), dtype=bool)
        alone[rows[symbols[rows, inner] < 0]] = True
        made = np.full(symbols.shape, -1, dtype=np.int32)
        score = np.full(symbols.shape, -np.inf, dtype=np.float32)
        made[:, :-1], score[:, :-1] = self.pair(symbols[:, :-1], symbols[:, 1:])
        # neighbours by position, so a merge touches single cells; a position that was merged into another holds -1
        after, before = np.tile(cols + 1, (len(units), 1)), np.tile(cols - 1, (len(units), 1))
        taken = np.zeros(len(units), dtype=np.int64)
        live = np.flatnonzero(~alone)
        for k in range(LANES + 1):
            now = score if len(live) == len(score) else score[live]
            best = now.argmax(axis=1)
            open_ = now[np.arange(len(live)), best] > -np.inf
            live, best = live[open_], best[open_]
            if k == LANES or not len(live):
                alone[live] = True
                break
            taken[live] += 1
            skipped = (patterns[live] >> np.uint32(k) & np.uint32(1)).astype(bool)
            score[live[skipped], best[skipped]] = -np.inf
            r, b = live[~skipped], best[~skipped]
            if not len(r):
                continue
            new, right = made[r, b], after[r, b]
            far = after[r, right]
            symbols[r, b], symbols[r, right], score[r, right] = new, -1, -np.inf
            after[r, b], before[r, far] = far, b
            made[r, b], score[r, b] = self.pair(new, symbols[r, far])
            left = before[r, b]
            inside = left >= 0
            q, at = r[inside], left[inside]
            made[q, at], score[q, at] = self.pair(symbols[q, at], new[inside])
        alone |= (symbols >= self.vocabulary).any(axis=1)
        count = (symbols >= 0).sum(axis=1)
        return symbols[symbols >= 0], count, alone, taken

    def merge_all(self, units: list[str], patterns):
        """``merge`` of any number of units, those of like length together; ids come as an array with begins and counts."""
        import numpy as np

        size = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        order = np.argsort(size, kind="stable")
        begin, count, alone, taken = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64), np.zeros(len(units), bool), np.zeros(len(units), np.int64)
        parts, end = [], 0
        for lo in range(0, len(order), ROWS):
            at = order[lo:lo + ROWS]
            ids, n, alone[at], taken[at] = self.merge([units[i] for i in at.tolist()], patterns[at])
            begin[at], count[at] = end + np.cumsum(n) - n, n
            parts.append(ids)
            end += len(ids)
        return np.concatenate(parts) if parts else np.empty(0, np.int32), begin, count, alone, taken


class DropoutEncoder:
    """Texts are encoded many at a time. Distinct units are merged once without skips; an occurrence whose draws skip none of the
    candidates taken there has that result. The others are merged once for each unit and pattern of draws."""

    def __init__(self, path: str):
        self.pieces = Pieces(path)
        self.many = SideBySide(self.pieces)

    @staticmethod
    def patterns(at, span, limit: int):
        """Bit k of a number: whether the k-th candidate of its unit is skipped. A 64-bit hash holds four draws; ``span`` draws are made."""
        import numpy as np

        out = np.zeros(len(at), dtype=np.uint32)
        some = np.arange(len(at))
        for lane in range(LANES // 4 if limit else 0):
            some = some[span[some] > 4 * lane]
            h = at[some] + np.uint64(lane * 0xD1B54A32D192ED03 & MASK)
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h = h ^ (h >> np.uint64(31))
            bits = np.zeros(len(some), dtype=np.uint32)
            for k in range(4):
                hit = (h >> np.uint64(16 * k)) & np.uint64(0xFFFF) < np.uint64(limit)
                bits |= hit.astype(np.uint32) << np.uint32(4 * lane + k)
            out[some] |= bits
        return out

    def alone(self, unit: str, at: int, limit: int) -> list[int]:
        def skip(k: int) -> bool:
            return (mix(at + (k // 4) * 0xD1B54A32D192ED03 & MASK) >> (16 * (k % 4))) & 0xFFFF < limit

        return merge(unit, self.pieces, skip)[0]

    def encode(self, texts: list[str], keys: list[int], chance: float):
        """(ids, counts): the ids of all texts one after the other, and the number of ids of each. A key stands for seed and
        document, ``chance`` is the probability of a skip."""
        import numpy as np
        import pyarrow as pa

        limit = int(chance * 65536)
        split = [UNIT.findall(" " + t) if t else [] for t in texts]
        n = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        coded = pa.array([u for units in split for u in units], pa.string()).dictionary_encode()
        unit, names = coded.indices.to_numpy(), [written(u) for u in coded.dictionary.to_pylist()]
        size = np.fromiter(map(len, names), dtype=np.int64, count=len(names))
        short = size <= LONGEST
        span = np.array(SPAN, dtype=np.int64)[np.minimum(size, LONGEST)]
        inner = np.arange(len(unit)) - np.repeat(np.cumsum(n) - n, n)
        at = inner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.repeat(np.array(keys, dtype=np.uint64), n)
        pattern = self.patterns(at, span[unit], limit)

        begin, count = np.zeros(len(unit), dtype=np.int64), np.zeros(len(unit), dtype=np.int64)
        # no skips: one result per unit
        some = np.flatnonzero(short)
        ids, b, c, alone, taken = self.many.merge_all([names[i] for i in some.tolist()], np.zeros(len(some), dtype=np.uint32))
        row = np.zeros(len(names), dtype=np.int64)
        row[some] = np.arange(len(some))
        plain = np.zeros(len(names), dtype=bool)
        plain[some] = ~alone & (taken <= span[some])
        used = np.zeros(len(names), dtype=np.uint32)
        used[some] = (np.uint64(1) << np.minimum(taken, 31).astype(np.uint64)) - np.uint64(1)
        easy = plain[unit] & (pattern & used[unit] == 0)
        begin[easy], count[easy] = b[row[unit[easy]]], c[row[unit[easy]]]
        # skips: one result per unit and pattern of the draws that it can use
        rest = np.flatnonzero(~easy & short[unit])
        pairs, which = np.unique(unit[rest].astype(np.int64) << 32 | pattern[rest], return_inverse=True)
        who = (pairs >> 32).tolist()
        more, b, c, alone, taken = self.many.merge_all([names[i] for i in who], (pairs & 0xFFFFFFFF).astype(np.uint32))
        begin[rest], count[rest] = b[which] + len(ids), c[which]
        ids = np.concatenate((ids, more))
        # what does not fit: one by one
        lost = alone | (taken > span[who]) if len(who) else alone
        single = np.concatenate((np.flatnonzero(~short[unit]), rest[lost[which]])) if len(rest) else np.flatnonzero(~short[unit])
        found = [self.alone(names[u], a, limit) for u, a in zip(unit[single].tolist(), at[single].tolist())]
        c = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        begin[single], count[single] = len(ids) + np.cumsum(c) - c, c
        ids = np.concatenate((ids, np.array([i for f in found for i in f], dtype=np.int32)))

        stops = np.cumsum(count)
        out = ids[np.repeat(begin - stops + count, count) + np.arange(int(stops[-1]) if len(stops) else 0)]
        ends = np.concatenate(([0], stops))[np.concatenate(([0], np.cumsum(n)))]
        return out.astype(np.int32), np.diff(ends)


def written(unit: str) -> str:
    """Spaces as the model writes them; a literal space sign is kept apart from a space."""
    return unit.replace(SPACE, "\0").replace(" ", SPACE)


@lru_cache(maxsize=2)
def encoder(path: str) -> DropoutEncoder:
    return DropoutEncoder(path)


def document_key(seed: int, doc_id: int | None, text: str) -> int:
    return mix(seed * 0x9E3779B97F4A7C15 + (zlib.crc32(text.encode()) if doc_id is None else doc_id) & MASK)


def encode(docs: DataFrame, model: str, seed: int, chance: float = 0.1) -> DataFrame:
    """doc_id, n_tokens, ids of every whole text (null: empty, without ids).

    Rows with equal doc_id and text get equal ids; a row without doc_id is keyed by its text. More columns are
    ignored, an empty table gives no rows, and texts are segmented whole whatever their length.
    """

    def make():
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        e = encoder(model)

        def step(batch):
            length = np.cumsum(np.asarray(pc.binary_length(batch.column("text"))).astype(np.int64))
            lo = 0
            while lo < batch.num_rows:  # as many texts as have AT_ONCE bytes, one at least
                done = int(length[lo - 1]) if lo else 0
                hi = max(lo + 1, int(np.searchsorted(length, done + AT_ONCE, side="right")))
                part = batch.slice(lo, hi - lo)
                lo = hi
                texts = part.column("text").to_pylist()
                keys = [document_key(seed, i, t) for i, t in zip(part.column("doc_id").to_pylist(), texts)]
                ids, n = e.encode(texts, keys, chance)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), lists], names=["doc_id", "n_tokens", "ids"])

        return step

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    return map_batches(rows, "doc_id bigint, n_tokens bigint, ids array<int>", make)


def decode_beside(encoded: DataFrame, model: str) -> DataFrame:
    """Adds ``text`` to doc_id, n_tokens, ids."""

    def make():
        import pyarrow as pa

        decode = encoder(model).pieces.decode_many

        def step(batch):
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                lists = part.column("ids")
                at = lists.offsets.to_numpy()
                ids = lists.values.to_numpy(zero_copy_only=False)[at[0]:at[-1]]
                texts = pa.array(decode(ids, at[1:] - at[0]), pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in ("doc_id", "n_tokens", "ids")), texts], names=["doc_id", "n_tokens", "ids", "text"])

        return step

    return map_batches(encoded.select("doc_id", "n_tokens", "ids"), "doc_id bigint, n_tokens bigint, ids array<int>, text string", make)
