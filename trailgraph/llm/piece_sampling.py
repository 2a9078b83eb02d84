"""Sampled segmentations over a SentencePiece vocabulary, and lossless decoding.

A text's lattice has an arc for each piece that matches and, for a character that is no piece, an arc of its byte pieces.
A segmentation's weight is the product of its arcs' weights to the power ``theta``.  *Forward filtering* sums the weights
of all segmentations up to each position; *backward sampling* then draws arcs from the end, each with its share of the
sum, which draws a segmentation with exactly its probability.  The uniform numbers are a hash of seed, row key, place and
step: the same row gives the same pieces on any cluster.

Vocabularies made by merges have ranks, not probabilities; a piece's weight is then 1 / (rank + ``RANK_SHIFT``), as word
frequencies go.  No piece spans from a word into the space before the next, so that the lattice falls into units, a run
of white space and the word after it, and the filtering of a unit is done once and serves all its occurrences.

Decoding maps pieces to bytes and takes the leading space away again; a text that holds the space symbol itself is
encoded by that symbol's byte pieces, so that decoding returns every text as it was.

Defined cases: null and empty texts have no piece and decode to the empty text; a null key is a key of its own; equal
texts under different keys may differ in pieces, never in the decoded text; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailgraph.llm.common import map_batches
from trailgraph.llm.words import HashIndex, chunk_groups, mix, powers, ragged

SPACE = "▁"
#: Stands for a space symbol that is in the text itself: beyond the last code point, so that no text and no piece has it.
_LITERAL = 0x110000
#: Bits of a share; a node's number has the 64 - 34 = 30 bits above.
SHARE_BITS = 34
RANK_SHIFT = 10.0
#: Log-weight of a byte piece.
BYTE_LOG = -math.log(50_000.0)
#: Units whose filtering is kept in a worker; those that come later are filtered again for each group of texts.
KEPT_UNITS = 150_000

_U = np.uint64
_LOADED: dict[tuple[str, float], "PieceSampler"] = {}


class Lattices:
    """Filtered lattices of many units.  A node is a position of a unit; ``cumulative`` has, for each arc that ends in node k,
    k above and the sum of the shares up to the arc's own below, in whole parts of 2**34.  A node's shares depend on
    its unit alone, so that a unit is drawn alike whatever else a worker holds."""

    def __init__(self) -> None:
        self.cumulative, self.previous = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        self.out_start, self.out_length = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.flat, self.ends = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
        self.nodes = 0

    def extend(self, nodes: int, shares: np.ndarray, node: np.ndarray, previous: np.ndarray, out_start: np.ndarray, out_length: np.ndarray, flat: np.ndarray, ends: np.ndarray) -> None:
        """Adds units; their arcs come by node, nodes and ids are numbered from 0."""
        whole = np.rint(shares * (1 << SHARE_BITS)).astype(np.uint64)
        self.cumulative = np.concatenate((self.cumulative, ((self.nodes + node).astype(np.uint64) << _U(SHARE_BITS)) + whole))
        self.previous = np.concatenate((self.previous, np.where(previous >= 0, previous + self.nodes, -1)))
        self.out_start = np.concatenate((self.out_start, out_start + len(self.flat)))
        self.out_length = np.concatenate((self.out_length, out_length))
        self.flat = np.concatenate((self.flat, flat))
        self.ends = np.concatenate((self.ends, ends + self.nodes))
        self.nodes += nodes

    def sample(self, units: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of the units, one after the other, and how many each has.  keys: 64 random bits for each."""
        cumulative, previous, out_start, out_length, flat = self.cumulative, self.previous, self.out_start, self.out_length, self.flat
        node, active = self.ends[units], np.arange(len(units))
        steps = np.zeros(len(units), dtype=np.int64)
        taken: list[tuple[np.ndarray, np.ndarray]] = []
        while len(active):
            draw = mix(keys[active] + steps[active].astype(np.uint64) * _U(0x9E3779B97F4A7C15)) >> _U(64 - SHARE_BITS)
            arc = np.searchsorted(cumulative, (node[active].astype(np.uint64) << _U(SHARE_BITS)) + draw, side="right")
            taken.append((active, arc))
            steps[active] += 1
            node[active] = previous[arc]
            active = active[previous[arc] >= 0]
        first = np.cumsum(steps) - steps
        arcs = np.empty(int(steps.sum()), dtype=np.int64)
        for step, (who, arc) in enumerate(taken):  # drawn from the end
            arcs[first[who] + steps[who] - 1 - step] = arc
        lengths = out_length[arcs]
        ids = flat[ragged(out_start[arcs], lengths)]
        sums = np.concatenate(([0], np.cumsum(lengths)))
        return ids, sums[first + steps] - sums[first]


def _prefix_sums(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Polynomial prefix sums of the codes, and the inverse powers that make stretches comparable."""
    up, down = powers(len(codes) + 1)
    total = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(mix(codes.astype(np.uint64) + _U(1)) * up[: len(codes)], out=total[1:])
    return total, down


def _piece_hash(total: np.ndarray, down: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    h = mix((total[at + n] - total[at]) * down[at] + _U(n))
    h[h == 0] = 1
    return h


class PieceSampler:
    def __init__(self, path: str, theta: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.theta = theta
        size = model.vocab_size()
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(size)]
        self.byte_ids = {int(model.id_to_piece(i)[3:5], 16): i for i in range(size) if model.is_byte(i)}
        normal = [i for i in range(size) if not special[i] and not model.is_byte(i)]
        ranked = sorted(normal, key=lambda i: (-model.get_score(i), i))
        self.pieces = {model.id_to_piece(i): (i, -theta * math.log(rank + RANK_SHIFT)) for rank, i in enumerate(ranked)}
        self.longest = max(map(len, self.pieces))
        self.ids = np.array([i for i, _ in self.pieces.values()], dtype=np.int32)
        self.weights = np.array([w for _, w in self.pieces.values()])
        self.numbers = HashIndex(18)
        codes = np.frombuffer("".join(self.pieces).encode("utf-32-le"), dtype=np.uint32)
        sizes = np.array([len(p) for p in self.pieces], dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        hashes = np.zeros(len(sizes), dtype=np.uint64)
        for n in range(1, self.longest + 1):
            of_size = np.flatnonzero(sizes == n)
            hashes[of_size] = _piece_hash(*_prefix_sums(codes), starts[of_size], n)
        self.numbers.add(hashes)
        if any(p.lstrip(SPACE).find(SPACE) >= 0 for p in self.pieces):
            raise ValueError("a piece spans two words")
        self.bytes = [b""] * size
        for piece, (i, _) in self.pieces.items():
            self.bytes[i] = piece.replace(SPACE, " ").encode()
        for value, i in self.byte_ids.items():
            self.bytes[i] = bytes([value])
        self.index, self.kept = HashIndex(19), Lattices()

    @classmethod
    def load(cls, path: str, theta: float) -> "PieceSampler":
        if (path, theta) not in _LOADED:
            _LOADED[path, theta] = cls(path, theta)
        return _LOADED[path, theta]

    def filter(self, lattices: Lattices, units: list[str]) -> None:
        """Forward filtering of units, all together, position by position."""
        codes = np.frombuffer("".join(units).encode("utf-32-le"), dtype=np.uint32).copy()
        codes[codes == ord(SPACE)] = _LITERAL
        codes[codes == ord(" ")] = ord(SPACE)
        size = np.array([len(u) for u in units], dtype=np.int64)
        first = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(units)), size)
        left = (first + size)[owner] - np.arange(len(codes))  # characters from here to the unit's end
        total, down = _prefix_sums(codes)
        start, length, number = [], [], []
        for n in range(1, self.longest + 1):
            at = np.flatnonzero(left >= n)
            found = self.numbers.find(_piece_hash(total, down, at, n))
            hit = found >= 0
            start.append(at[hit])
            number.append(found[hit].astype(np.int64))
            length.append(np.full(int(hit.sum()), n))
            if n == 1:
                bare = at[~hit]
        # Characters that are no piece: an arc of byte pieces, one entry for each different character.
        chars, which = np.unique(codes[bare], return_inverse=True)
        raw = [(SPACE if c == _LITERAL else chr(c)).encode() for c in chars.tolist()]
        byte_sizes = np.array([len(r) for r in raw], dtype=np.int64)
        flat = np.concatenate((self.ids, np.array([self.byte_ids[x] for r in raw for x in r], dtype=np.int32)))
        start = np.concatenate((*start, bare))
        length = np.concatenate((*length, np.ones(len(bare), dtype=np.int64)))
        out_start = np.concatenate((*number, (len(self.ids) + np.cumsum(byte_sizes) - byte_sizes)[which]))
        out_length = np.concatenate((np.ones(sum(map(len, number)), dtype=np.int64), byte_sizes[which]))
        weight = np.concatenate((self.weights[np.concatenate(number)], self.theta * BYTE_LOG * byte_sizes[which]))
        node = start + length - 1  # one node a character: the position after it
        order = np.argsort(node, kind="stable")
        start, length, node, out_start, out_length, weight = (x[order] for x in (start, length, node, out_start, out_length, weight))
        previous = np.where(start > first[owner[start]], start - 1, -1)

        alpha = np.zeros(len(codes))
        shares = np.empty(len(node))
        place = node - first[owner[node]]
        by_place = np.argsort(place, kind="stable")
        cuts = np.searchsorted(place[by_place], np.arange(int(size.max()) + 1))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            arcs = by_place[a:b]
            at = node[arcs]
            heads = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
            counts = np.diff(np.append(heads, len(at)))
            logs = weight[arcs] + np.where(previous[arcs] >= 0, alpha[previous[arcs]], 0.0)
            top = np.maximum.reduceat(logs, heads)
            # A row a node, so that no sum runs from one node into the next.
            row, column = np.repeat(np.arange(len(heads)), counts), np.arange(len(at)) - np.repeat(heads, counts)
            linear = np.zeros((len(heads), int(counts.max())))
            linear[row, column] = np.exp(logs - np.repeat(top, counts))
            running = np.cumsum(linear, axis=1)
            sums = running[:, -1]
            alpha[at[heads]] = top + np.log(sums)
            shares[arcs] = (running / sums[:, None])[row, column]
        lattices.extend(len(codes), shares, node, previous, out_start, out_length, flat, first + size - 1)

    def _sample_units(self, hashes: np.ndarray, spelled, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """spelled(i): the unit i as text."""
        number = self.index.find(hashes)
        new = np.flatnonzero(number < 0)
        if len(new):
            distinct, first, back = np.unique(hashes[new], return_index=True, return_inverse=True)
            keep = len(self.kept.ends) < KEPT_UNITS
            lattices = self.kept if keep else Lattices()
            self.filter(lattices, [spelled(i) for i in new[first].tolist()])
            if keep:
                self.index.add(distinct)
                number[new] = self.index.find(hashes[new])
                return self.kept.sample(number, keys)
            old = np.flatnonzero(number >= 0)
            ids_a, n_a = self.kept.sample(number[old], keys[old])
            ids_b, n_b = lattices.sample(back, keys[new])
            lengths, starts = np.empty(len(hashes), dtype=np.int64), np.empty(len(hashes), dtype=np.int64)
            lengths[old], lengths[new] = n_a, n_b
            starts[old], starts[new] = np.cumsum(n_a) - n_a, len(ids_a) + np.cumsum(n_b) - n_b
            return np.concatenate((ids_a, ids_b))[ragged(starts, lengths)], lengths
        return self.kept.sample(number, keys)

    def encode_batch(self, keys: list[int | None], texts: list[str | None], seed: int) -> list[np.ndarray]:
        """A sampled segmentation of each text."""
        row = mix(np.array([-1 if k is None else k for k in keys], dtype=np.int64).view(np.uint64) + _U((2 * seed + 1) * 0xD6E8FEB86659FD93 % (1 << 64)))
        row[[k is None for k in keys]] ^= _U(0x5851F42D4C957F2D)
        out: list[np.ndarray] = []
        for group in chunk_groups(texts, lower=False):
            starts, ends, first, offsets = group.starts, group.ends, group.first, group.offsets
            owner = np.repeat(np.arange(group.hi - group.lo), np.diff(first))
            begin = np.concatenate(([0], ends[:-1]))
            begin[first[:-1][np.diff(first) > 0]] = offsets[:-1][np.diff(first) > 0]
            gap = starts - begin  # white space before the word; a text's first word has the added space too
            initial = np.zeros(len(starts), dtype=bool)
            initial[first[:-1][np.diff(first) > 0]] = True
            data, hashes = group.data, group.hashes.copy()
            odd = np.flatnonzero(np.where(initial, gap > 0, (gap != 1) | (np.frombuffer(data, dtype=np.uint8)[begin] != 0x20)))
            before: dict[int, bytes] = {}
            for i in odd.tolist():
                before[i] = (b" " if initial[i] else b"") + data[begin[i] : starts[i]]
            if len(odd):
                spaces = np.array([int.from_bytes(hashlib.blake2b(before[i], digest_size=8).digest(), "little") for i in odd.tolist()], dtype=np.uint64)
                hashes[odd] = mix(hashes[odd] + spaces * _U(0x2545F4914F6CDD1D) + _U(1))
            # White space after a text's last word is a unit of its own.
            last = np.where(np.diff(first) > 0, ends[np.maximum(first[1:] - 1, 0)] if len(ends) else 0, offsets[:-1])
            tails = [(i, (b"" if first[i + 1] > first[i] else b" ") + data[a:b]) for i, (a, b) in enumerate(zip(last.tolist(), (offsets[1:] - 1).tolist())) if b > a]
            n = len(hashes)
            place = np.arange(n) - first[owner] if n else np.zeros(0, dtype=np.int64)
            if tails:
                tail_hash = np.array([int.from_bytes(hashlib.blake2b(t, digest_size=8, key=b"tail").digest(), "little") | 1 for _, t in tails], dtype=np.uint64)
                hashes = np.concatenate((hashes, tail_hash))
                tail_owner = np.array([i for i, _ in tails])
                owner = np.concatenate((owner, tail_owner))
                place = np.concatenate((place, np.diff(first)[tail_owner]))

            def spelled(i: int) -> str:
                if i >= n:
                    return tails[i - n][1].decode()
                return (before.get(i, b" ") + data[starts[i] : ends[i]]).decode()

            keys_of = mix(row[group.lo + owner] + place.astype(np.uint64) * _U(0xC2B2AE3D27D4EB4F))
            ids, lengths = self._sample_units(hashes, spelled, keys_of)
            if tails:  # back into text order
                order = np.lexsort((place, owner))
                at = np.cumsum(lengths) - lengths
                ids, lengths, owner = ids[ragged(at[order], lengths[order])], lengths[order], owner[order]
            size = np.bincount(owner, weights=lengths, minlength=group.hi - group.lo).astype(np.int64)
            cuts = np.concatenate(([0], np.cumsum(size))).tolist()
            out += [ids[a:b] for a, b in zip(cuts, cuts[1:])]
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of a segmentation."""
        return b"".join([self.bytes[i] for i in ids])[1:].decode()


def sampled_pieces(docs: DataFrame, model_path: str, seed: int, theta: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids``: a sampled segmentation of every text."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        ids = PieceSampler.load(model_path, theta).encode_batch(b.column(0).to_pylist(), b.column(1).to_pylist(), seed)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(rows, run, "doc_id long, ids array<int>")


def decoded_texts(pieces: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, text`` of ``doc_id, ids``; null ids give the empty text."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        sampler = PieceSampler.load(model_path, 1.0)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([sampler.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return map_batches(pieces.select("doc_id", "ids"), run, "doc_id long, text string")


def round_trips(docs: DataFrame, model_path: str, seed: int, theta: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_pieces, ids_crc32, decoded_sha256, lossless``: pieces and decoded text in digest, in one pass."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        sampler = PieceSampler.load(model_path, theta)
        texts = b.column(1).to_pylist()
        rows = []
        for key, text, ids in zip(b.column(0).to_pylist(), texts, sampler.encode_batch(b.column(0).to_pylist(), texts, seed)):
            back = sampler.decode(ids.tolist())
            rows.append((key, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), hashlib.sha256(back.encode()).hexdigest(), back == (text or "")))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["doc_id", "n_pieces", "ids_crc32", "decoded_sha256", "lossless"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(rows, run, "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string, lossless boolean")
