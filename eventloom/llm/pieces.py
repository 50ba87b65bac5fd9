"""SentencePiece BPE encoding with seeded merge-dropout, and lossless decoding.

Encoding keeps an agenda of adjacent symbol pairs whose union is a piece; the best piece merges
first, the leftmost of equals. Each candidate merge is skipped for good if a keyed hash of (seed,
variant, segment, where the two symbols start, meet and end) falls below the dropout rate. The
variant is a hash of (seed, document id, place of the segment), so each occurrence of a word is cut
by itself, and every run gives the same ids. With dropout 0 the ids are those of the sentencepiece library.

No piece of the model holds a word mark after another character, so a text is cut to segments before
runs of marks and around line feeds, and segments are encoded apart, all of one length at a time, a
merge per round. Segments longer than ``LONG`` symbols use a heap. Of a segment met ``OFTEN`` times a worker
keeps the list of candidate merges; the ids depend on which of these are skipped alone, so they are
encoded once for each different set of skipped ones.

Characters without a piece, and the word mark itself when a text holds it, become byte pieces, so
decoding gives back each text exactly.

Defined results: a null text is empty, and an empty text has no ids; a null doc_id is hashed as such;
rows that repeat a doc_id get the same ids for the same text; an empty table gives no rows; columns of the
documents pass through :func:`with_ids` unless they bear its names. Whole texts, however long.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import MUL, holding, mixed

MARK = "▁"
LONG = 64
OFTEN, MOST = 8, 40  # occurrences from which, and number up to which, a segment's candidates are kept
BATCH_CHARS = 3_000_000
SEGMENTS = re.compile(f"{MARK}+[^{MARK}\n]*|\n|[^{MARK}\n]+")
NEVER = 2**31 - 1
ESCAPED = "\udfff"  # stands for a word mark of the text itself; no text from UTF-8 holds a lone surrogate


class Model:
    """Pieces, their ranks, and the pairs that merge, from a sentencepiece model file."""

    def __init__(self, path: str):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        n = p.get_piece_size()
        self.byte_ids = np.zeros(256, np.int64)
        self.data: list[bytes] = [b""] * n
        pieces: dict[str, int] = {}
        for i in range(n):
            piece = p.id_to_piece(i)
            if p.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.data[i] = bytes([int(piece[3:5], 16)])
            elif not (p.is_control(i) or p.is_unknown(i) or p.is_unused(i)):
                pieces[piece] = i
                self.data[i] = piece.replace(MARK, " ").encode("utf-8")
        symbols = dict(pieces)
        for piece in pieces:  # characters that occur in pieces alone may merge as well
            for c in piece:
                symbols.setdefault(c, n + len(symbols))
        self.n, self.symbols = n, symbols
        scores = {i: -p.get_score(i) for i in pieces.values()}
        places = {s: k for k, s in enumerate(sorted(set(scores.values())))}
        pairs = {}
        for piece, i in pieces.items():
            for k in range(1, len(piece)):
                a, b = symbols.get(piece[:k]), symbols.get(piece[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = (i, places[scores[i]])
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k][0] for k in self.keys.tolist()], np.int64)
        self.ranks = np.array([pairs[k][1] for k in self.keys.tolist()], np.int32)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merged ids and ranks of pairs; the rank of a pair that doesn't merge is ``NEVER``."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key.ravel()), len(self.keys) - 1).reshape(key.shape)
        hit = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return self.merged[at], np.where(hit, self.ranks[at], np.int32(NEVER))

    def symbol_ids(self, segment: str) -> list[int]:
        """A symbol for each character; -2 - code point where there is none."""
        return [self.symbols.get(c, -2 - ord(c)) for c in segment]

    def finish(self, symbols: list[int], segment_chars: dict[int, str] | None = None) -> list[int]:
        """Ids of merged symbols; characters without a piece as bytes."""
        out: list[int] = []
        for s in symbols:
            if 0 <= s < self.n:
                out.append(s)
            else:
                c = chr(-2 - s) if s < 0 else self.loose(s)
                out += self.byte_ids[list((MARK if c == ESCAPED else c).encode("utf-8"))].tolist()
        return out

    def loose(self, s: int) -> str:
        return next(c for c, i in self.symbols.items() if i == s)

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.data.__getitem__, ids.tolist()))
        return raw.decode("utf-8")[1:]  # the space before the first word is encoding's own


def dropped(key: np.ndarray, start: np.ndarray, middle: np.ndarray, end: np.ndarray, rate: float) -> np.ndarray:
    """Whether the keyed hash skips the merge of [start, middle) and [middle, end)."""
    h = mixed(key + (start.astype(np.uint64) << np.uint64(42)) + (middle.astype(np.uint64) << np.uint64(21)) + end.astype(np.uint64))
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53 < rate


def agenda_merge(model: Model, symbols: list[int], key: int, rate: float) -> list[int]:
    """The agenda itself, for one segment: a heap of candidates and a linked list of symbols."""
    n = len(symbols)
    symbols, start = list(symbols), list(range(n + 1))
    following, before, end = [*range(1, n), -1], list(range(-1, n - 1)), list(range(1, n + 1))
    heap: list[tuple[int, int, int, int, int]] = []

    def offer(i: int) -> None:
        j = following[i]
        if j >= 0 and symbols[i] >= 0 and symbols[j] >= 0 and (hit := model.pairs.get(symbols[i] << 32 | symbols[j])):
            spans = (np.array([x]) for x in (start[i], start[j], end[j]))
            if rate and dropped(np.array([key], np.uint64), *spans, rate)[0]:
                return
            heapq.heappush(heap, (hit[1], start[i], i, end[i], end[j]))

    for i in range(n):
        offer(i)
    alive = [True] * n
    while heap:
        _, _, i, middle, stop = heapq.heappop(heap)
        j = following[i] if alive[i] else -1
        if j < 0 or end[i] != middle or end[j] != stop:
            continue
        symbols[i], end[i], alive[j] = model.pairs[symbols[i] << 32 | symbols[j]][0], stop, False
        following[i] = following[j]
        if following[j] >= 0:
            before[following[j]] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    out, i = [], 0
    while i >= 0:
        out.append(symbols[i])
        i = following[i]
    return out


def merge_equal_lengths(model: Model, symbols: np.ndarray, keys: np.ndarray, rate: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Merges segments of one length, a row each; gives (rows, symbols) for each final length.
    A round merges the best pair of every row and looks up the two pairs that this makes."""
    rows = np.arange(len(symbols))
    if symbols.shape[1] == 1:
        return [(rows, symbols)]
    done = []
    edges = np.broadcast_to(np.arange(symbols.shape[1] + 1, dtype=np.int32), (len(symbols), symbols.shape[1] + 1))
    merged, ranks = model.look_up(symbols[:, :-1], symbols[:, 1:])
    if rate:
        r, c = np.nonzero(ranks < NEVER)
        skip = dropped(keys[r], c, c + 1, c + 2, rate)
        ranks[r[skip], c[skip]] = NEVER
    while True:
        best = ranks.argmin(axis=1)
        go = ranks[np.arange(len(rows)), best] < NEVER
        if not go.all():
            done.append((rows[~go], symbols[~go]))
            rows, symbols, edges, keys, best, merged, ranks = rows[go], symbols[go], edges[go], keys[go], best[go], merged[go], ranks[go]
        if not len(rows):
            return done
        k, at = symbols.shape[1], np.arange(len(rows))
        chosen = merged[at, best]
        if k == 2:
            done.append((rows, chosen[:, None]))
            return done
        # the right symbol, the edge between the two and the pair itself go
        other = np.arange(k) != best[:, None] + 1
        symbols = symbols[other].reshape(-1, k - 1)
        symbols[at, best] = chosen
        edges = edges[np.arange(k + 1) != best[:, None] + 1].reshape(-1, k)
        other = np.arange(k - 1) != best[:, None]
        merged, ranks = merged[other].reshape(-1, k - 2), ranks[other].reshape(-1, k - 2)
        for own, place in ((best > 0, best - 1), (best < k - 2, best)):
            r = np.flatnonzero(own)
            c = place[r]
            m, rank = model.look_up(symbols[r, c], symbols[r, c + 1])
            if rate:
                rank[dropped(keys[r], edges[r, c], edges[r, c + 1], edges[r, c + 2], rate)] = NEVER
            merged[r, c], ranks[r, c] = m, rank


def spans(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``BATCH_CHARS`` characters, which bound the memory of a step."""
    a = 0
    while a < len(texts):
        b, size = a, 0
        while b < len(texts) and (b == a or size + len(texts[b] or "") <= BATCH_CHARS):
            size += len(texts[b] or "")
            b += 1
        yield a, b
        a = b


def candidate_spans(model: Model, symbols: list[int]) -> list[tuple[int, int, int]]:
    """(start, middle, end) of every merge that some order of merges can offer."""
    at = {(i, i + 1): s for i, s in enumerate(symbols) if s >= 0}
    begun: list[list[tuple[int, int]]] = [[(i + 1, s)] if s >= 0 else [] for i, s in enumerate(symbols)]  # (end, symbol) of the spans from a place
    out, n, pairs = [], len(symbols), model.pairs
    for width in range(2, n + 1):
        for start in range(n - width + 1):
            end, found = start + width, None
            for middle, a in begun[start]:
                b = at.get((middle, end))
                if b is not None and (hit := pairs.get(a << 32 | b)):
                    found = hit[0]
                    out.append((start, middle, end))
            if found is not None:
                at[start, end] = found
                begun[start].append((end, found))
    return out


class _Codes(dict):
    """Key -> number in order of first use; all keys of a batch at once."""

    def __init__(self):
        self.names: list = []

    def of(self, keys: list) -> np.ndarray:
        out = np.fromiter(map(self.get, keys, repeat(-1)), np.int64, len(keys))
        missing = out < 0
        if missing.any():
            unknown = list(compress(keys, missing.tolist()))
            new = list(dict.fromkeys(unknown))
            self.update(zip(new, range(len(self.names), len(self.names) + len(new)), strict=True))
            self.names += new
            out[missing] = np.fromiter(map(self.__getitem__, unknown), np.int64, len(unknown))
        return out


class Encoder:
    def __init__(self, model: Model, rate: float, seed: int, variants: int | None = None):
        self.model, self.rate, self.seed, self.variants = model, rate, seed, variants
        self._forget()
        self.characters = np.full(65536, -1, np.int64)
        for c, i in model.symbols.items():
            if len(c) == 1 and ord(c) < 65536:
                self.characters[ord(c)] = i

    LIMIT = 100_000  # segments that a Python worker remembers
    KEPT = 200_000  # and encodings

    def _forget(self) -> None:
        self.known, self.slots, self.flat, self.used = _Codes(), _Codes(), np.empty(1 << 16, np.int32), 0
        self.begin, self.sizes = np.empty(0, np.int64), np.empty(0, np.int64)  # of each encoding
        self.hashes, self.seen = np.empty(0, np.uint64), np.empty(0, np.int64)  # of each segment
        self.first, self.many = np.empty(0, np.int64), np.empty(0, np.int64)  # its candidates; -1 if not kept
        self.spans, self.n_spans = np.empty((3, 1 << 12), np.int64), 0

    def _forget_rare(self) -> None:
        """Forgets segments met seldom, and encodings where they are too many; the candidates of common segments stay."""
        keep = self.seen >= OFTEN
        if keep.sum() > self.LIMIT // 2:
            self._forget()
            return
        code = np.cumsum(keep) - 1
        names, known = self.known.names, _Codes()
        known.of(list(compress(names, keep.tolist())))
        self.known = known
        self.hashes, self.seen, self.first, self.many = (x[keep] for x in (self.hashes, self.seen, self.first, self.many))
        states, slots = np.array(self.slots.names, np.int64), _Codes()
        own = np.flatnonzero(keep[states >> MOST]) if len(states) <= self.KEPT else states[:0]
        slots.of((code[states[own] >> MOST] << MOST | states[own] & ((1 << MOST) - 1)).tolist())
        begin, sizes = self.begin[own], self.sizes[own]
        self.slots, self.sizes, self.used = slots, sizes, int(sizes.sum())
        self.begin = np.cumsum(sizes) - sizes
        whole = self.flat[np.repeat(begin - self.begin, sizes) + np.arange(self.used)]
        self.flat = np.append(whole, np.empty(1 << 16, np.int32))

    def _meet(self, codes: np.ndarray) -> None:
        """Notes new segments, and the candidates of those now met often."""
        names = self.known.names
        new = len(names) - len(self.seen)
        self.hashes = np.append(self.hashes, np.fromiter((xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass")) for s in names[len(self.seen) :]), np.uint64, new))
        self.first, self.many = np.append(self.first, np.full(new, -1)), np.append(self.many, np.zeros(new, np.int64))
        before = np.append(self.seen, np.zeros(new, np.int64))
        self.seen = before + np.bincount(codes, minlength=len(names))
        for c in np.flatnonzero((before < OFTEN) & (self.seen >= OFTEN)).tolist():
            own = candidate_spans(self.model, self.model.symbol_ids(names[c])) if self.rate and len(names[c]) <= MOST else []
            if len(own) > MOST or self.rate and len(names[c]) > MOST:
                continue
            if self.n_spans + len(own) > self.spans.shape[1]:
                self.spans = np.concatenate([self.spans, np.empty_like(self.spans)], axis=1)
            if own:
                self.spans[:, self.n_spans : self.n_spans + len(own)] = np.array(own).T
            self.first[c], self.many[c] = self.n_spans, len(own)
            self.n_spans += len(own)

    def _skipped(self, codes: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Which of its segment's candidates each occurrence skips, as bits."""
        out, first, many = np.zeros(len(codes), np.int64), self.first[codes], self.many[codes]
        rows = np.argsort(-many, kind="stable")
        left = np.searchsorted(-many[rows], -np.arange(many.max(initial=0)), "left")
        for k, n in enumerate(left.tolist()):
            own = rows[:n]
            out[own] |= dropped(keys[own], *self.spans[:, first[own] + k], self.rate).astype(np.int64) << k
        return out

    def segment_keys(self, hashes: np.ndarray, variant: np.ndarray) -> np.ndarray:
        return mixed(hashes ^ mixed(np.uint64(self.seed) + variant.astype(np.uint64) * MUL))

    def encode_segments(self, segments: list[str], hashes: np.ndarray, variant: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of (segment, variant) pairs, flat, and where each one starts."""
        return self._encode_keys(segments, self.segment_keys(hashes, variant))

    def _encode_keys(self, segments: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.fromiter(map(len, segments), np.int64, len(segments))
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # rows, counts, ids
        for length in np.unique(lengths).tolist():
            rows = np.flatnonzero(lengths == length)
            if length > LONG:
                for i in rows.tolist():
                    ids = self.model.finish(agenda_merge(self.model, self.model.symbol_ids(segments[i]), int(keys[i]), self.rate))
                    parts.append((np.array([i]), np.array([len(ids)]), np.array(ids, np.int64)))
                continue
            points = np.frombuffer("".join(segments[i] for i in rows.tolist()).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64).reshape(-1, length)
            symbols = np.where(points < 65536, self.characters[np.minimum(points, 65535)], -1)
            for r, c in zip(*np.nonzero(points >= 65536), strict=True):
                symbols[r, c] = self.model.symbols.get(chr(points[r, c]), -1)
            symbols = np.where(symbols < 0, -2 - points, symbols)
            for own, final in merge_equal_lengths(self.model, symbols, keys[rows], self.rate):
                plain = ((final >= 0) & (final < self.model.n)).all(axis=1)
                if plain.any():
                    parts.append((rows[own[plain]], np.full(int(plain.sum()), final.shape[1]), final[plain].ravel()))
                for i, row in zip(own[~plain].tolist(), final[~plain].tolist(), strict=True):
                    ids = self.model.finish(row)
                    parts.append((rows[[i]], np.array([len(ids)]), np.array(ids, np.int64)))
        order = np.concatenate([p[0] for p in parts])
        counts = np.concatenate([p[1] for p in parts])
        flat = np.concatenate([p[2] for p in parts])
        starts = np.zeros(len(segments) + 1, np.int64)
        starts[order + 1] = counts
        starts = np.cumsum(starts)
        source = np.repeat(np.cumsum(counts) - counts, counts)
        within = np.arange(len(flat)) - source
        out = np.empty(len(flat), np.int64)
        out[np.repeat(starts[order], counts) + within] = flat
        return out, starts

    def encode(self, ids: list[int | None], texts: list[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text as int32."""
        for a, b in spans(texts):
            yield from self._encode(ids[a:b], texts[a:b])

    def _encode(self, ids: list[int | None], texts: list[str | None]) -> list[np.ndarray]:
        segments: list[str] = []
        counts = []
        for t in texts:
            own = SEGMENTS.findall(MARK + t.replace(MARK, ESCAPED).replace(" ", MARK)) if t else []
            counts.append(len(own))
            segments += own
        if not segments:
            return [np.empty(0, np.int32) for _ in texts]
        counts = np.array(counts)
        codes = self.known.of(segments)
        key = np.array([xxhash.xxh64_intdigest(repr(i), self.seed) for i in ids], np.uint64)
        place = np.arange(len(codes)) - np.repeat(np.cumsum(counts) - counts, counts)
        variant = mixed(np.repeat(key, counts) + place.astype(np.uint64) * MUL)
        if self.variants:
            variant %= np.uint64(self.variants)
        self._meet(codes)
        keys = self.segment_keys(self.hashes[codes], variant)
        often, single = np.flatnonzero(self.first[codes] >= 0), np.flatnonzero(self.first[codes] < 0)
        states, example, state = np.unique(codes[often] << MOST | self._skipped(codes[often], keys[often]), return_index=True, return_inverse=True)
        n_known = len(self.slots.names)
        slot = self.slots.of(states.tolist())
        rows = np.concatenate([often[example[slot >= n_known]], single])
        if len(rows):
            found, starts = self._encode_keys([segments[i] for i in rows.tolist()], keys[rows])
            if self.used + len(found) > len(self.flat):
                self.flat = np.append(self.flat[: self.used], np.empty(max(len(found), len(self.flat)), np.int32))
            self.flat[self.used : self.used + len(found)] = found
            starts, n_new = self.used + starts, len(rows) - len(single)
            self.begin, self.sizes = np.append(self.begin, starts[:n_new]), np.append(self.sizes, np.diff(starts)[:n_new])
            self.used = int(starts[n_new])  # the next batch writes over what is not kept
        begin, sizes = np.empty(len(codes), np.int64), np.empty(len(codes), np.int64)
        begin[often], sizes[often] = self.begin[slot[state]], self.sizes[slot[state]]
        if len(single):
            begin[single], sizes[single] = starts[n_new:-1], np.diff(starts)[n_new:]
        within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        whole = self.flat[np.repeat(begin, sizes) + within]
        if len(self.known.names) > self.LIMIT or len(self.slots.names) > self.KEPT:
            self._forget_rare()
        ends = np.cumsum(np.bincount(np.repeat(np.arange(len(texts)), counts), sizes, len(texts)).astype(np.int64))
        return np.split(whole, ends[:-1])


_MODELS: dict[str, Model] = {}
_ENCODERS: dict[tuple, Encoder] = {}


def _release() -> None:
    _MODELS.clear()
    _ENCODERS.clear()


def encoder_for(path: str, rate: float, seed: int, variants: int | None) -> Encoder:
    """A Python worker's model and encoder, kept from one task to the next until another operator has the worker."""
    holding("pieces", _release)
    model = _MODELS.get(path) or _MODELS.setdefault(path, Model(path))
    key = (path, rate, seed, variants)
    return _ENCODERS.get(key) or _ENCODERS.setdefault(key, Encoder(model, rate, seed, variants))


def _coded(batches: Iterator[pa.RecordBatch], encoder: Encoder, id_col: str, text_col: str) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], pa.Array]]:
    """Slices of the batches with their texts' ids and whether these decode to the texts."""
    for batch in batches:
        names, texts = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (id_col, text_col))
        for a, b in spans(texts):
            ids = encoder._encode(names[a:b], texts[a:b])
            yield batch.slice(a, b - a), ids, pa.array([encoder.model.decode(x) == (t or "") for x, t in zip(ids, texts[a:b], strict=True)], pa.bool_())


def with_ids(documents: DataFrame, model_path: str, rate: float = 0.1, seed: int = 17, variants: int | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``documents`` with ids (array of int) and lossless: whether decoding them gives the text."""
    documents = documents.drop("ids", "lossless")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, ids, lossless in _coded(batches, encoder_for(model_path, rate, seed, variants), id_col, text_col):
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids)))
            yield pa.RecordBatch.from_arrays([*rows.columns, lists, lossless], names=[*rows.schema.names, "ids", "lossless"])

    schema = T.StructType([*documents.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("lossless", T.BooleanType())])
    return documents.mapInArrow(encode, schema)


def id_digests(documents: DataFrame, model_path: str, rate: float = 0.1, seed: int = 17, variants: int | None = None) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (of the ids as little-endian 32-bit integers) and lossless."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, ids, lossless in _coded(batches, encoder_for(model_path, rate, seed, variants), "doc_id", "text"):
            sizes, crcs = pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index("doc_id")), sizes, crcs, lossless], names=["doc_id", "n_ids", "ids_crc32", "lossless"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(digest, "doc_id long, n_ids long, ids_crc32 long, lossless boolean")
