"""SentencePiece encoding and decoding by suffix-array matching.

A batch's text, spaces as U+2581, is cut where no piece reaches across (a U+2581 behind another character)
and each distinct unit, new to the worker, is put once into one long text. A suffix array of that text,
sorted to the length of the longest piece, lets every piece be found by binary search: its occurrences are
a range of the array. The occurrences, sorted by position, are the edges of a lattice, which is then
relaxed: for a unigram model by best score from left to right; for a byte-pair model by merging, in every
unit at once, the adjacent pair whose joint edge has the best score, the leftmost first, until none is left.
Characters on no edge become byte pieces (or the unknown id). Ids equal those of the reference library.

Edge cases: a null or empty text has no ids; a text of blanks keeps them; very long units are merged many
pairs a round; an empty table gives no rows. Decoding drops control pieces, joins byte pieces as UTF-8 (bytes
that are none become U+FFFD) and takes the leading blank away. Other columns are passed over.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .memo import Memo, gather
from .word_bpe import slices

BLANK = "▁"
_NONE = np.iinfo(np.int32).max
_ENCODERS: dict[str, "PieceEncoder"] = {}
_SLICE, _INDEXED, _DECODED = 4 << 20, 300_000, 1_000
_NORMAL, _UNKNOWN, _CONTROL, _USER, _BYTE = 1, 2, 3, 4, 6


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes in the order of their first `depth` codes, by prefix doubling."""
    rank, step = codes.astype(np.int64), 1
    while step < depth:
        ahead = np.zeros_like(rank)
        ahead[:-step] = rank[step:] + 1
        rank = np.unique(rank * (int(rank.max(initial=0)) + 2) + ahead, return_inverse=True)[1].ravel()
        step *= 2
    return np.argsort(rank, kind="stable")


def occurrences(codes: np.ndarray, pieces: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, piece numbers) of all occurrences of `pieces` (rows of codes from 1, filled up with 0) in
    `codes`, where 0 separates units; sorted by start."""
    depth = pieces.shape[1]
    order = suffix_array(codes, depth)
    # numbers as big-endian bytes whose last byte is never 0 compare like the rows themselves
    spread = lambda x: np.where(x > 0, x + (x - 1) // 255, 0).astype(">u4")
    width = 4 * (depth + 1)
    padded = np.concatenate([spread(codes), np.zeros(depth + 1, ">u4")]).astype(">u4")
    windows = np.lib.stride_tricks.sliding_window_view(padded, depth + 1)[order]
    windows[:, depth] = 0
    table = np.ascontiguousarray(windows).view(f"S{width}").ravel()
    low = np.zeros((len(pieces), depth + 1), ">u4")
    low[:, :depth] = spread(pieces)
    high = low.copy()
    high[np.arange(len(pieces)), lengths] = 0xFFFFFFFF
    first = np.searchsorted(table, np.ascontiguousarray(low).view(f"S{width}").ravel(), "left")
    last = np.searchsorted(table, np.ascontiguousarray(high).view(f"S{width}").ravel(), "left")
    starts, number = gather(order, first, last - first), np.repeat(np.arange(len(pieces)), last - first)
    by_start = np.argsort(starts, kind="stable")
    return starts[by_start], number[by_start]


def relax_unigram(starts, ends, scores, unit_starts, unit_ends, unknown: float) -> tuple[np.ndarray, np.ndarray]:
    """Best path per position: (previous position, edge or -1 for a lone character) on the way to each end.
    Edges are sorted by start; all units advance together, one offset a turn."""
    n = int(unit_ends.max(initial=0)) + 1
    best, back, by = np.full(n, -np.inf), np.full(n, -1), np.full(n, -1)
    best[unit_starts] = 0.0
    bounds = np.searchsorted(starts, np.arange(n + 1))
    for offset in range(int((unit_ends - unit_starts).max(initial=0))):
        at = unit_starts[unit_starts + offset < unit_ends] + offset
        counts = bounds[at + 1] - bounds[at]
        edge = gather(np.arange(len(starts)), bounds[at], counts)
        origin, target = np.concatenate([starts[edge], at]), np.concatenate([ends[edge], at + 1])
        value = best[origin] + np.concatenate([scores[edge], np.full(len(at), unknown)])
        order = np.lexsort((value, target))
        origin, target, value, edge = origin[order], target[order], value[order], np.concatenate([edge, np.full(len(at), -1)])[order]
        top = np.append(target[1:] != target[:-1], True)
        top[top] = value[top] > best[target[top]]
        best[target[top]], back[target[top]], by[target[top]] = value[top], origin[top], edge[top]
    return back, by


def relax_merges(table: np.ndarray, rank: np.ndarray, begins: np.ndarray, sizes: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merges symbols (begin, size, unit; one a character at first) until no adjacent pair is an edge.
    `table[begin, size - 1]` is the piece on that edge or -1, `rank` the order of pieces by score."""
    depth, done = table.shape[1], []

    def joint(begin, size):
        piece = np.where(size <= depth, table[begin, np.minimum(size, depth) - 1], -1)
        return np.where(piece >= 0, rank[piece], _NONE)

    while len(begins):
        n, ahead = len(begins), np.arange(len(begins) - 1)
        mates = np.append(unit[1:] == unit[:-1], False)
        cost = np.full(n, _NONE)
        cost[:-1][mates[:-1]] = joint(begins[ahead[mates[:-1]]], sizes[ahead[mates[:-1]]] + sizes[ahead[mates[:-1]] + 1])
        heads = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
        counts = np.diff(np.append(heads, n))
        best = np.minimum.reduceat(cost, heads)
        alive = np.repeat(best < _NONE, counts)
        if not alive.all():
            done.append((begins[~alive], sizes[~alive], unit[~alive]))
            begins, sizes, unit, cost, best = begins[alive], sizes[alive], unit[alive], cost[alive], np.repeat(best, counts)[alive]
        else:
            best = np.repeat(best, counts)
        if not len(begins):
            break
        pick = np.flatnonzero(cost == best)
        run = np.flatnonzero(np.append(True, np.diff(pick) > 1))  # overlapping picks: every other one from the left
        place = np.arange(len(pick)) - np.repeat(run, np.diff(np.append(run, len(pick))))
        pick = pick[place % 2 == 0]
        # several at once only if no merge makes a pair that would have come first
        chosen = np.zeros(len(begins) + 2, bool)
        chosen[pick] = True
        both, own = sizes[pick] + sizes[pick + 1], best[pick]
        after, before, earlier = np.minimum(pick + 2, len(begins) - 1), np.maximum(pick - 1, 0), np.maximum(pick - 2, 0)
        early = np.where((pick + 2 < len(begins)) & (unit[after] == unit[pick]), joint(begins[pick], both + sizes[after]), _NONE)
        early = np.minimum(early, np.where((pick > 0) & (unit[before] == unit[pick]), joint(begins[before], sizes[before] + both), _NONE))
        merged = (pick > 1) & chosen[earlier] & (unit[earlier] == unit[pick])
        early = np.minimum(early, np.where(merged, joint(begins[earlier], sizes[earlier] + sizes[before] + both), _NONE))
        lead = np.append(True, unit[pick][1:] != unit[pick][:-1])
        group = np.cumsum(lead) - 1
        risky = np.minimum.reduceat(np.where(early <= own, 0, 1), np.flatnonzero(lead))[group] == 0
        pick = pick[lead | ~risky]
        sizes = sizes.copy()
        sizes[pick] += sizes[pick + 1]
        keep = np.ones(len(begins), bool)
        keep[pick + 1] = False
        begins, sizes, unit = begins[keep], sizes[keep], unit[keep]
    if not done:
        return begins, sizes, unit
    begins, sizes, unit = (np.concatenate(x) for x in zip(*done))
    order = np.argsort(begins, kind="stable")
    return begins[order], sizes[order], unit[order]


class PieceEncoder(Memo):
    """Encoder and decoder from pieces, scores and kinds (numbers as in the model file)."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[int], unigram: bool, byte_fallback: bool = True):
        self.pieces, self.kinds, self.unigram = pieces, np.array(kinds), unigram
        self.scores = np.array(scores, np.float64)
        self.unknown = kinds.index(_UNKNOWN)
        self.bytes = {int(p[1:-1], 16): i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == _BYTE} if byte_fallback else {}
        usable = [i for i, k in enumerate(kinds) if k in (_NORMAL, _USER)]
        self.usable, self.letters = np.array(usable), sorted({c for i in usable for c in pieces[i]})
        self.code = {c: i + 1 for i, c in enumerate(self.letters)}
        self.lengths = np.array([len(pieces[i]) for i in usable])
        self.depth = int(self.lengths.max())
        self.rows = np.zeros((len(usable), self.depth), np.int64)
        for r, i in enumerate(usable):
            self.rows[r, : len(pieces[i])] = [self.code[c] for c in pieces[i]]
        self.rank = np.empty(len(pieces), np.int64)
        self.rank[np.lexsort((np.arange(len(pieces)), -self.scores))] = np.arange(len(pieces))
        self.splits = not any(BLANK in pieces[i].lstrip(BLANK) for i in usable)
        points = np.zeros(0x110000, np.int64)
        points[[ord(c) for c in self.letters]] = list(self.code.values())
        self.points = points
        plain = [p.replace(BLANK, " ") if k in (_NORMAL, _USER) else "" for p, k in zip(pieces, kinds)]
        plain[self.unknown] = " ⁇ "
        for byte, i in self.bytes.items():
            plain[i] = chr(byte) if byte < 128 else ""
        self.plain, self.spelled = pa.array(plain), plain
        self.beyond = np.zeros(len(pieces), bool)  # byte pieces that are no character alone
        self.beyond[[i for byte, i in self.bytes.items() if byte >= 128]] = True
        super().__init__(np.dtype(np.int32))

    def fresh(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """One indexed text for each run of whole units of about 300 KB."""
        stops = np.cumsum(pc.binary_length(strings).to_numpy(zero_copy_only=False).astype(np.int64))
        borders = np.unique(np.searchsorted(stops, np.arange(_INDEXED, stops[-1], _INDEXED), "right"))
        parts = [self._indexed(strings[a:b]) for a, b in zip([0, *borders.tolist()], [*borders.tolist(), len(strings)]) if b > a]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _indexed(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        units = strings.to_numpy(zero_copy_only=False).tolist()
        text = "".join(f"{u}\0" for u in units)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        unit_starts = np.cumsum(sizes + 1) - sizes - 1
        codes = self.points[points]
        # a character on no piece still has a place in the text; it sorts behind all others
        codes[(codes == 0) & (points != 0)] = len(self.letters) + 1
        borders = np.zeros(len(codes), bool)
        borders[unit_starts + sizes] = True
        codes[borders] = 0
        starts, row = occurrences(codes, self.rows, self.lengths)
        piece, length = self.usable[row], self.lengths[row]
        if self.unigram:
            begins, ids, owner = self._walk(starts, starts + length, piece, unit_starts, unit_starts + sizes)
        else:
            table = np.full((len(codes), self.depth), -1, np.int16 if len(self.pieces) < 1 << 15 else np.int32)
            table[starts, length - 1] = piece
            inner = np.flatnonzero(~borders)
            begins, spans, owner = relax_merges(table, self.rank, inner, np.ones(len(inner), np.int64), np.repeat(np.arange(len(units)), sizes))
            ids = np.where(spans <= self.depth, table[begins, np.minimum(spans, self.depth) - 1], -1)
        lone = np.flatnonzero(ids < 0)
        counts = np.ones(len(ids), np.int64)
        spelled = {i: self._spell(chr(points[begins[i]])) for i in lone.tolist()}
        counts[lone] = [len(x) for x in spelled.values()]
        out = np.repeat(ids, counts)
        place = np.cumsum(counts) - counts
        for i, own in spelled.items():
            out[place[i] : place[i] + len(own)] = own
        return out.astype(np.int32), np.bincount(owner, counts, len(units)).astype(np.int64)

    def _walk(self, starts, ends, piece, unit_starts, unit_ends):
        back, by = relax_unigram(starts, ends, self.scores[piece], unit_starts, unit_ends, float(self.scores[self.usable].min()) - 10)
        begins, ids, owner, at, unit = [], [], [], unit_ends.copy(), np.arange(len(unit_ends))
        live = at > unit_starts
        at, unit = at[live], unit[live]
        while len(at):
            begins.append(back[at])
            ids.append(np.where(by[at] >= 0, piece[by[at]] if len(piece) else -1, -1))
            owner.append(unit)
            at = back[at]
            live = at > unit_starts[unit]
            at, unit = at[live], unit[live]
        if not begins:
            return (np.zeros(0, np.int64),) * 3
        begins, ids, owner = map(np.concatenate, (begins, ids, owner))
        order = np.argsort(begins, kind="stable")
        return begins[order], ids[order], owner[order]

    def _spell(self, character: str) -> list[int]:
        return [self.bytes[b] for b in character.encode()] if self.bytes else [self.unknown]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and where each text's start (and the last end)."""
        texts = pc.fill_null(texts, "")
        filled = pc.greater(pc.binary_length(texts), 0)
        marked = pc.replace_substring(pc.binary_join_element_wise(BLANK, texts, ""), "  ", f" {BLANK}")
        while pc.any(pc.match_substring(marked, f"{BLANK} ")).as_py():
            marked = pc.replace_substring(marked, f"{BLANK} ", BLANK * 2)
        marked = pc.utf8_slice_codeunits(marked, 1)
        if not self.splits:
            marked = pc.replace_substring(marked, " ", BLANK)
        lists = pc.split_pattern(marked, " ")
        coded = lists.flatten().dictionary_encode()
        entry = self.entries(pc.binary_join_element_wise(BLANK, coded.dictionary, ""))[coded.indices.to_numpy()]
        bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        sizes = self.sizes[entry].astype(np.int64)
        sizes[np.repeat(~filled.to_numpy(zero_copy_only=False), np.diff(bounds))] = 0
        return gather(self.flat, self.starts[entry], sizes), np.concatenate([[0], np.cumsum(sizes)])[bounds]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """Texts of runs of ids."""
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), self.plain.take(pa.array(ids))), "")
        out = joined.to_pylist()
        for i in np.unique(np.searchsorted(bounds, np.flatnonzero(self.beyond[ids]), "right") - 1).tolist():
            out[i] = self._with_bytes(ids[bounds[i] : bounds[i + 1]].tolist())
        return [t[1:] if t.startswith(" ") else t for t in out]

    def _with_bytes(self, ids: list[int]) -> str:
        parts, held = [], b""
        for i in [*ids, None]:
            if i is not None and self.kinds[i] == _BYTE:
                held += bytes([int(self.pieces[i][1:-1], 16)])
                continue
            while held:
                try:
                    parts.append(held.decode())
                    held = b""
                except UnicodeDecodeError as e:
                    parts.append(held[: e.start].decode() + "�")
                    held = held[e.start + 1 :]
            parts += [] if i is None else [self.spelled[i]]
        return "".join(parts)


def encoder(path: str) -> PieceEncoder:
    """One encoder per worker process and model file."""
    if path not in _ENCODERS:
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        spec = model.normalizer_spec
        if spec.name != "identity" or not spec.add_dummy_prefix or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only models that keep the text as it is, behind a leading blank")
        _ENCODERS[path] = PieceEncoder(
            [p.piece for p in model.pieces], [p.score for p in model.pieces], [p.type for p in model.pieces],
            model.trainer_spec.model_type == 1, model.trainer_spec.byte_fallback)
    return _ENCODERS[path]


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """(`key`, `ids`) of every document."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                ids, bounds = enc.encode(part.column("text"))
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], [key, "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(encoded, f"`{key}` {kind}, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """(`key`, `n_ids`, `ids_crc32`, `text`) from (`key`, `ids`)."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for part in (batch.slice(i, _DECODED) for batch in batches for i in range(0, batch.num_rows, _DECODED)):
            lists = part.column(1)
            bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            ids = lists.flatten().to_numpy()
            crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(np.diff(bounds).astype(np.int64)), pa.array(crc, pa.int64()), pa.array(enc.decode(ids, bounds), pa.string())],
                [key, "n_ids", "ids_crc32", "text"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(key, "ids").mapInArrow(decoded, f"`{key}` {kind}, n_ids long, ids_crc32 long, text string")
