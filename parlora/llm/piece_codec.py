"""SentencePiece encoding and decoding with N-best segmentation.

A text is cut into pieces of a public model so that the sum of the pieces' scores is greatest. Over the lattice of a
unit (a word with the spaces before it, which no piece of such models crosses) Viterbi gives forward scores; they are
exact heuristics for a backward A-star search, which pops the N best segmentations of the unit in order. Viterbi runs
over all distinct units of a batch at once that the process hasn't met before; it keeps what it found for the units
that come most often. The N best of a document deviate from its best one only in the N - 1
units whose second-best segmentations cost least, so A-star runs for those and their lists are merged.

A character that is no piece costs a fixed penalty and becomes its UTF-8 bytes as byte pieces, so decoding gives
back every text exactly; a literal U+2581, the sign that stands for a space, is spelled in bytes too. Scores are the
model's own. For a model of type BPE they are ranks of merges, so the best segmentation is the best path of the
lattice, not the outcome of greedy merging.

Cases: a null text gives null ids, score and alternatives; the empty text gives no pieces and score 0. Equal scores
are ordered by longer pieces from the end. Repeated rows and null or repeated ``doc_id`` stay as they are, extra
columns are ignored, very long texts and units are handled whole, and an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import os
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import U64, mix
from .ship import give_back, received, send, ship

#: Where the driver has the vocabulary file of a public tokenizer by default; the executors get it from the driver.
MODEL = os.environ.get("PARLORA_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
N_BEST = 4
_SPACE, _LITERAL, _NEVER = 0x2581, 0x110001, 0xD800
_UNIT = re.compile(r"\n| *[^ \n]+| +")
_LONG_UNIT = 48
_CHUNK = 1 << 21
#: Units whose segmentations a process keeps between batches; beyond that the half that came in fewer batches goes.
_KEPT = 200_000
_B = 0x9E3779B97F4A7C15 | 1
_UNKNOWN = -1
EDIT = "struct<start:int,length:int,ids:array<int>>"
SCHEMA = f"doc_id long, n_pieces int, score double, ids array<int>, alternatives array<struct<rank:int,score:double,edits:array<{EDIT}>>>, round_trip boolean"


def _hash(codes: np.ndarray) -> np.ndarray:
    """Prefix sums from which the hash of a substring is read (columns are positions)."""
    power = np.multiply.accumulate(np.concatenate((np.ones(1, U64), np.full(codes.shape[-1], _B, U64))))
    total = np.zeros((*codes.shape[:-1], codes.shape[-1] + 1), U64)
    np.cumsum((codes.astype(U64) + U64(1)) * power[:-1], axis=-1, out=total[..., 1:])
    return total


class Pieces:
    """The pieces of a model, with lookups for lattices."""

    def __init__(self, path: str = MODEL) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.n, self.scores = n, np.array([model.get_score(i) for i in range(n)], np.float64)
        self.bytes_of: list[bytes] = [b""] * n
        self.byte_id = np.full(256, _UNKNOWN, np.int64)
        self.ids: dict[str, int] = {}
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[1:-1], 16)] = i
                self.bytes_of[i] = bytes([int(piece[1:-1], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.ids[piece] = i
                self.bytes_of[i] = piece.replace("▁", " ").encode()
        if (self.byte_id < 0).any():
            raise ValueError("the model has no byte pieces")
        if any("▁" in p.lstrip("▁") for p in self.ids):
            raise ValueError("the model has pieces that cross a space")
        self.longest = max(map(len, self.ids))
        self.penalty = float(self.scores[list(self.ids.values())].clip(-1e6).min() - 10)
        self.score_of = self.scores.tolist()
        self.cost = np.append(self.scores, self.penalty)  # at -1 the penalty
        strings = sorted(self.ids)
        inverse, keys = np.uint64(pow(_B, -1, 1 << 64)), np.empty(len(strings), U64)
        for k, s in enumerate(strings):
            keys[k] = _hash(np.array([ord(c) for c in s], np.int64))[-1]
        self._maybe = np.zeros(1 << 21, bool)
        self._maybe[self._slot(keys)] = True
        keys = mix(keys)
        self.down = np.multiply.accumulate(np.concatenate((np.ones(1, U64), np.full(_LONG_UNIT + 1, inverse, U64))))
        self._tables = []
        left = np.arange(len(strings))
        values = np.array([self.ids[s] for s in strings], np.int64)
        for shift in (44, 24, 4):
            slot = (keys[left] >> U64(shift)).astype(np.int64) & 0xFFFFF
            first = np.unique(slot, return_index=True)[1]
            table = np.full(1 << 20, -1, np.int32)
            table[slot[first]] = left[first]
            self._tables.append((shift, table))
            left = np.setdiff1d(left, left[first])
        if len(left):
            raise ValueError("the pieces' hashes collide")
        self._keys, self._values = keys, values

    @staticmethod
    def _slot(raw: np.ndarray) -> np.ndarray:
        return ((raw * U64(_B)) >> U64(43)).view(np.int64)

    def find(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in ``raw``, pieces) of the substring hashes that are a piece's; most others go by one look at a bit."""
        there = np.flatnonzero(self._maybe[self._slot(raw)])
        key = mix(raw[there])
        out = np.full(len(key), _UNKNOWN, np.int64)
        for shift, table in self._tables:
            at = table[(key >> U64(shift)).astype(np.int64) & 0xFFFFF]
            hit = (at >= 0) & (self._keys[at] == key)
            out[hit] = self._values[at[hit]]
        hit = out >= 0
        return there[hit], out[hit]

    def edges(self, unit: str) -> list[list[tuple[int, int, float]]]:
        """For each end, (begin, piece or -1, score) of the lattice's edges into it, longer pieces first."""
        chars, piece, out = unit.replace("▁", chr(_NEVER)).replace(" ", "▁"), self.ids.get, [[]]
        for j in range(1, len(chars) + 1):
            own = []
            for i in range(max(0, j - self.longest), j):
                p = piece(chars[i:j])
                if p is not None:
                    own.append((i, p, self.score_of[p]))
            if not own or own[-1][0] != j - 1:
                own.append((j - 1, _UNKNOWN, self.penalty))
            out.append(own)
        return out

    def spelled(self, unit: str, path: list[tuple[int, int, int]]) -> list[int]:
        """Piece ids of a path of (begin, end, piece or -1)."""
        out: list[int] = []
        for i, j, p in path:
            out += [p] if p >= 0 else [int(self.byte_id[b]) for b in unit[i:j].encode()]
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of piece ids, without the space that encoding puts in front."""
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def forward(edges: list[list[tuple[int, int, float]]]) -> tuple[list[float], list[tuple[int, int, int]]]:
    """Viterbi scores of all positions, and the best path."""
    alpha, back = [0.0], [(0, 0, 0)]
    for j in range(1, len(edges)):
        best, via = -np.inf, (0, 0, 0)
        for i, p, s in edges[j]:
            if alpha[i] + s > best:
                best, via = alpha[i] + s, (i, j, p)
        alpha.append(best)
        back.append(via)
    path, j = [], len(edges) - 1
    while j:
        path.append(back[j])
        j = back[j][0]
    return alpha, path[::-1]


def n_best(edges: list[list[tuple[int, int, float]]], n: int) -> list[tuple[float, list[tuple[int, int, int]]]]:
    """The n best paths of a lattice, the Viterbi path first, by backward A-star with forward scores as heuristics.

    Among equals the place nearest to the beginning is popped first, so a lattice with very many equal paths (a long
    run of one letter) costs one walk a path.
    """
    alpha, best = forward(edges)
    end = len(edges) - 1
    queue, ticket, out = [(round(-alpha[end], 6), end, 0, 0.0, None)], 0, []
    while queue and len(out) < n:
        f, j, _, g, tail = heapq.heappop(queue)
        if j == 0:
            path = []
            while tail is not None:
                path.append(tail[0])
                tail = tail[1]
            out.append((-f, path))
            continue
        for i, p, s in edges[j]:
            ticket += 1
            heapq.heappush(queue, (round(-(g + s + alpha[i]), 6), i, ticket, g + s, ((i, j, p), tail)))
    paths = [p for _, p in out]
    at = paths.index(best) if best in paths else len(out) - 1
    del out[at]
    return [(alpha[end], best), *out]


class _Places(dict):
    """Units in the order in which they came first, each with its place."""

    def __missing__(self, unit: str) -> int:
        place = self[unit] = len(self)
        return place


class Codec:
    """Encodes batches of texts; keeps what it found for units that come often or need an A-star search."""

    def __init__(self, pieces: Pieces, n: int) -> None:
        self.pieces, self.n, self.kept = pieces, n, {}
        self.places, self.names, self._long = _Places(), [], False
        # By place: where the ids of the best segmentation begin in the store and how many there are, its score, what
        # the second best costs more, and in how many batches the unit came.
        self.store, self.begin, self.lens = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)
        self.score, self.cost, self.came = np.empty(0), np.empty(0), np.empty(0, np.int32)

    def _trim(self) -> None:
        """Before a batch: drop long units, and beyond ``_KEPT`` the half that came in fewer batches."""
        if not self.names or (len(self.names) <= _KEPT and not self._long):
            return
        stays = np.fromiter(map(len, self.names), np.int64, len(self.names)) <= _LONG_UNIT
        if len(self.names) > _KEPT:
            order = np.argsort(-self.came, kind="stable")
            stays[order[_KEPT // 2 :]] = False
            self.came //= 2
        self.names = [u for u, x in zip(self.names, stays.tolist()) if x]
        self.places = _Places(zip(self.names, range(len(self.names))))
        begin, self.lens = self.begin[stays], self.lens[stays]
        self.begin = np.cumsum(self.lens) - self.lens
        self.store = self.store[np.arange(self.lens.sum()) + np.repeat(begin - self.begin, self.lens)]
        self.score, self.cost, self.came = self.score[stays], self.cost[stays], self.came[stays]

    def _learn(self) -> None:
        """Segment the units that came to ``places`` since the last time."""
        new = list(islice(self.places, len(self.names), None))
        self._long = any(len(u) > _LONG_UNIT for u in new)
        if not new:
            return
        best, score, cost = self.units(new)
        lens = np.fromiter(map(len, best), np.int64, len(best))
        self.begin = np.concatenate((self.begin, len(self.store) + np.cumsum(lens) - lens))
        self.store = np.concatenate((self.store, *best))
        self.lens = np.concatenate((self.lens, lens))
        self.score, self.cost = np.concatenate((self.score, score)), np.concatenate((self.cost, cost))
        self.came = np.concatenate((self.came, np.zeros(len(new), np.int32)))
        self.names += new

    def _searched(self, unit: str) -> list[tuple[float, list[int]]]:
        found = self.kept.get(unit)
        if found is None:
            if len(self.kept) > 20_000:
                self.kept.clear()
            found = [(s, self.pieces.spelled(unit, p)) for s, p in n_best(self.pieces.edges(unit), self.n)]
            if len(unit) <= _LONG_UNIT:
                self.kept[unit] = found
        return found

    def units(self, units: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """(ids of the best segmentation, its score, what the second best costs more) of distinct units."""
        p, best = self.pieces, [None] * len(units)
        score, cost = np.zeros(len(units)), np.full(len(units), np.inf)
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        order = np.argsort(-sizes, kind="stable")
        for u in order[: np.count_nonzero(sizes > _LONG_UNIT)]:
            edges = p.edges(units[u])
            alpha, path = forward(edges)
            best[u] = np.array(p.spelled(units[u], path), np.int32)
            score[u] = alpha[-1]
            if self.n > 1:
                two = n_best(edges, 2)
                cost[u] = alpha[-1] - two[1][0] if len(two) > 1 else np.inf
        order = order[np.count_nonzero(sizes > _LONG_UNIT) :]
        for s in range(0, len(order), 8192):
            self._viterbi(units, order[s : s + 8192], sizes[order[s : s + 8192]], best, score, cost)
        return best, score, cost

    def _viterbi(self, units, group, sizes, best, score, cost) -> None:
        """All units of ``group`` at once, longer ones first, so those that reach an end are the first rows."""
        p, m, length = self.pieces, len(group), int(sizes[0])
        codes = np.frombuffer("".join([units[u].ljust(length, "\0") for u in group.tolist()]).encode("utf-32-le"), np.uint32).reshape(m, length).astype(np.int64)
        codes = np.where(codes == _SPACE, _LITERAL, codes)
        codes = np.where(codes == 32, _SPACE, codes)
        total = np.ascontiguousarray(_hash(codes).T)
        alpha = np.full((length + 1, m), -np.inf)
        alpha[0] = 0
        back = np.zeros((length + 1, m), np.int64)
        piece = np.zeros((length + 1, m), np.int64)
        lattice, every = [], np.arange(m)
        for j in range(1, length + 1):
            least, reach = max(0, j - p.longest), int(np.searchsorted(-sizes, -j, "right"))
            found, pieces = p.find(((total[j, :reach] - total[least:j, :reach]) * p.down[least:j, None]).reshape(-1))
            cuts = np.searchsorted(found, np.arange(j - least + 1) * reach)
            for i in range(least, j):
                part = slice(cuts[i - least], cuts[i - least + 1])
                there, own = found[part] - (i - least) * reach, pieces[part]
                if i == j - 1:
                    alone = np.full(reach, _UNKNOWN, np.int64)
                    alone[there] = own
                    there, own = every[:reach], alone
                if not len(there):
                    continue
                s = p.cost[own]
                value = alpha[i][there] + s
                better = value > alpha[j][there]
                at = there[better]
                alpha[j][at], back[j][at], piece[j][at] = value[better], i, own[better]
                lattice.append((i, j, there, s))
        score[group] = whole = alpha[sizes, every]
        pos, rows, parts = sizes.copy(), every, []
        on_path = np.full((length + 1, m), -1, np.int64)
        while len(rows):
            i, own = back[pos[rows], rows], piece[pos[rows], rows]
            on_path[pos[rows], rows] = i
            parts.append((rows, i, own))
            pos[rows] = i
            rows = rows[i > 0]
        owner = np.concatenate([r for r, _, _ in parts])
        begin, ids = np.concatenate([i for _, i, _ in parts]), np.concatenate([o for _, _, o in parts])
        by = np.lexsort((begin, owner))
        owner, begin, ids = owner[by], begin[by], ids[by]
        if (ids < 0).any():
            spelled = [[int(x)] if x >= 0 else [int(p.byte_id[b]) for b in units[group[o]][i].encode()] for x, o, i in zip(ids, owner, begin)]
            owner = np.repeat(owner, [len(x) for x in spelled])
            ids = np.array([y for x in spelled for y in x], np.int64)
        cuts = np.searchsorted(owner, np.arange(m + 1)).tolist()
        ids = ids.astype(np.int32)
        for k, u in enumerate(group.tolist()):
            best[u] = ids[cuts[k] : cuts[k + 1]]
        if self.n > 1:
            beta = np.full((length + 1, m), -np.inf)
            beta[sizes, every] = 0
            second = np.full(m, -np.inf)
            for i, j, there, s in reversed(lattice):  # edges into later ends first, so beta[j] is final
                rest = beta[j][there]
                beta[i][there] = np.maximum(beta[i][there], rest + s)
                through = alpha[i][there] + s + rest
                through[on_path[j][there] == i] = -np.inf
                second[there] = np.maximum(second[there], through)
            cost[group] = whole - second

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
        """(all ids, offsets by text, scores, alternatives) of texts that aren't null."""
        self._trim()
        at, places, ends = self.places.__getitem__, [], [0]
        for t in texts:
            if t:
                places += map(at, _UNIT.findall(" " + t))
            ends.append(len(places))
        self._learn()
        units, lens, store, begin, unit_score, cost = self.names, self.lens, self.store, self.begin, self.score, self.cost
        flat, unit_off = np.array(places, np.int64), np.array(ends)
        self.came[np.bincount(flat, minlength=len(units)) > 0] += 1
        size = lens[flat]
        start = np.concatenate(([0], np.cumsum(size)))
        ids = store[np.arange(start[-1]) + np.repeat(begin[flat] - start[:-1], size)] if len(flat) else store[:0]
        offsets = start[unit_off]
        sums = np.concatenate(([0.0], np.cumsum(unit_score[flat])))
        scores = np.round(sums[unit_off[1:]] - sums[unit_off[:-1]], 6)
        alternatives = []
        for d in range(len(texts)):
            a, b = unit_off[d], unit_off[d + 1]
            if self.n < 2 or a == b:
                alternatives.append([])
                continue
            own = cost[flat[a:b]]
            k = min(self.n - 1, b - a)
            limit = np.partition(own, k - 1)[k - 1]
            low = np.flatnonzero(own < limit)
            picked = np.concatenate((low, np.flatnonzero(own == limit)[: k - len(low)])) if np.isfinite(limit) else low
            alternatives.append(self._merge([int(x) for x in np.sort(picked)], flat[a:b], units, start[a:b] - start[a], lens, scores[d]))
        return ids, offsets, scores, alternatives

    def _merge(self, picked, flat, units, start, lens, score) -> list:
        """Ranks 2 to n of a document: combinations of deviations of the picked units."""
        combos: list[tuple[float, tuple]] = [(0.0, ())]
        for at in picked:
            found = self._searched(units[flat[at]])
            more = [(c + found[0][0] - s, (*edits, (at, r))) for c, edits in combos for r, (s, _) in enumerate(found[1:], 1)]
            combos = sorted(combos + more)[: self.n]
        out = []
        for rank, (c, edits) in enumerate(combos[1:], 2):
            rows = [{"start": int(start[at]), "length": int(lens[flat[at]]), "ids": self._searched(units[flat[at]])[r][1]} for at, r in edits]
            out.append({"rank": rank, "score": float(round(score - c, 6)), "edits": rows})
        return out


_OPEN: dict[tuple[str, int], Codec] = {}


def codec(path: str = MODEL, n: int = N_BEST) -> Codec:
    """The codec of a model file, opened once in a process."""
    if (path, n) not in _OPEN:
        _OPEN[path, n] = Codec(Pieces(path), n)
    return _OPEN[path, n]


def _type(n: int) -> pa.Schema:
    edit = pa.struct([("start", pa.int32()), ("length", pa.int32()), ("ids", pa.list_(pa.int32()))])
    other = pa.struct([("rank", pa.int32()), ("score", pa.float64()), ("edits", pa.list_(edit))])
    return pa.schema([("doc_id", pa.int64()), ("n_pieces", pa.int32()), ("score", pa.float64()), ("ids", pa.list_(pa.int32())), ("alternatives", pa.list_(other)), ("round_trip", pa.bool_())])


def _run(name: str, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, schema = codec(received(name), n), _type(n)
        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to] or "") <= _CHUNK):
                    size += len(texts[to] or "")
                    to += 1
                places = _Places()  # repeated texts, as mixing makes them, are encoded once
                which = pa.array([places[t] for t in texts[at:to]], pa.int64())
                part = list(places)
                null = np.array([t is None for t in part])
                ids, offsets, scores, alternatives = own.encode([t or "" for t in part])
                lens = np.diff(offsets).astype(np.int32)
                whole = ids.tolist()
                same = [None if t is None else own.pieces.decode(whole[offsets[k] : offsets[k + 1]]) == t for k, t in enumerate(part)]
                off = pa.array(np.where(np.append(null, False), None, offsets.astype(np.int32).astype(object)), pa.int32()) if null.any() else pa.array(offsets.astype(np.int32))
                found = pa.RecordBatch.from_arrays(
                    [
                        pa.array(lens, mask=null), pa.array(scores, mask=null), pa.ListArray.from_arrays(off, pa.array(ids, pa.int32())),
                        pa.array([None if z else a for a, z in zip(alternatives, null)], schema.field("alternatives").type), pa.array(same, pa.bool_()),
                    ],
                    names=schema.names[1:],
                )
                found = found if len(part) == to - at else found.take(which)
                yield pa.RecordBatch.from_arrays([doc_ids.slice(at, to - at), *found.columns], schema=schema)
                at = to
        give_back()

    return run


def encode(docs: DataFrame, model: str = MODEL, n: int = N_BEST) -> DataFrame:
    """(doc_id, n_pieces, score, ids, alternatives, round_trip) of every row of ``docs``.

    ``ids`` is the best segmentation. ``alternatives`` holds ranks 2 to ``n``, fewer where the lattice has fewer
    paths, each with its score and its ``edits``: at ``start``, ``length`` ids of the best segmentation are replaced
    by ``ids``. ``round_trip`` says whether decoding gave back the text.
    """
    ship(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(_run(send(docs.sparkSession, model), n), SCHEMA)


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) of ``encoded`` (doc_id, ids); null ids give a null text."""
    ship(encoded.sparkSession)
    name = send(encoded.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = codec(received(name), 1).pieces
        for batch in batches:
            texts = [None if x is None else pieces.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def apply_edits(ids: list[int], edits: list) -> list[int]:
    """The ids of an alternative."""
    out, at = [], 0
    for e in sorted(edits, key=lambda e: e["start"]):
        out += [*ids[at : e["start"]], *e["ids"]]
        at = e["start"] + e["length"]
    return out + list(ids[at:])
