"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Compiled once per executor process from a model file:

* the normaliser rewrites the text by the model's own rules, longest rule first, takes surplus white space away where
  the model says so, maps a space to the meta sign and puts one in front;
* the lexicon is an automaton over signs whose final states are pieces; a state is named by the signs that lead to it;
* the byte fallback maps every sign outside the lexicon to its UTF-8 byte pieces;
* the bigram acceptor weighs each pair of neighbouring pieces.

The composition with an input is its lattice of pieces; the encoding is the shortest path in the tropical semiring.
In a merge (BPE) model the weight of a pair is zero where the merges of the two pieces' text end in just these two,
and infinite otherwise. A segmentation is the merge result if and only if each neighbouring pair is such a pair:
the first merge across a boundary of two pieces would also be made between the two alone. So exactly one path has
finite weight. In a unigram model pairs weigh nothing and a piece weighs the negative of its score.

A path may be cut wherever two signs never stand together inside a piece: no arc crosses the cut. The stretches
between cuts repeat, so each is sought once for many texts, and its path is kept in a bounded table. Cuts, equal
stretches, ids and decoded texts are columns of a batch; Python sees the distinct stretches alone.
"""

from __future__ import annotations

import math
import sys
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

#: The model that the query takes unless told otherwise; it stays where it is installed.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
META = "▁"
#: Entries of the tables of known stretches and (four times) pairs; signs that are encoded at a time, a longer text alone.
_KEPT = 100_000
_SIGNS = 1 << 20


def rules_of(charsmap: bytes) -> dict[str, str]:
    """The rewriting rules of a compiled map: a double-array trie of UTF-8 keys, then the values, each ended by a zero.

    A unit of the array holds the label of the byte that leads to it, the offset of its children, and whether the
    first child is a leaf, whose unit is the place of the value.
    """
    if not charsmap:
        return {}
    size = int.from_bytes(charsmap[:4], "little")
    units = array("I", charsmap[4 : 4 + size])
    if sys.byteorder == "big":
        units.byteswap()
    values, found = charsmap[4 + size :], {}
    offset = lambda u: (u >> 10) << ((u & 512) >> 6)
    open_nodes = [(offset(units[0]), b"")]
    while open_nodes:
        base, key = open_nodes.pop()
        for byte in range(1, 256):
            at = base ^ byte
            if at >= len(units) or units[at] & 0x800000FF != byte:
                continue
            unit, longer = units[at], key + bytes([byte])
            children = at ^ offset(unit)
            if unit >> 8 & 1:
                start = units[children] & 0x7FFFFFFF
                found[longer.decode()] = values[start : values.index(b"\0", start)].decode()
            open_nodes.append((children, longer))
    return found


class _Known(dict):
    """The ids of known stretches; those of others are worked out by ``made``."""

    def __init__(self, made):
        self.made = made

    def __missing__(self, stretch: bytes) -> tuple[int, ...]:
        return self.made(stretch)


class Transducer:
    """The compiled model. ``encode`` composes it with a text, ``decode`` runs it backwards."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        read = sentencepiece.SentencePieceProcessor(model_proto=model)
        spec = proto.ModelProto()
        spec.ParseFromString(model)
        normaliser = spec.normalizer_spec
        if not normaliser.escape_whitespaces:
            raise ValueError("a model that keeps spaces as they are is not compiled")
        if spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("white space as a suffix is not compiled")
        if any(p.type == proto.ModelProto.SentencePiece.USER_DEFINED for p in spec.pieces):
            raise ValueError("pieces that users define are not compiled")
        self.prefix = META if normaliser.add_dummy_prefix else ""
        self.squeezed = normaliser.remove_extra_whitespaces
        self.rules = rules_of(normaliser.precompiled_charsmap)
        self.rule_lengths: dict[str, int] = {}
        for key in self.rules:
            self.rule_lengths[key[0]] = max(len(key), self.rule_lengths.get(key[0], 0))
        self.merges = spec.trainer_spec.model_type == spec.trainer_spec.BPE
        self.unknown = read.unk_id()
        count = read.vocab_size()
        self.text = [read.id_to_piece(i) for i in range(count)]
        self.score = [read.get_score(i) for i in range(count)]
        self.byte = {int(self.text[i][3:5], 16): i for i in range(count) if read.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte.items()}
        plain = [i for i in range(count) if not (read.is_byte(i) or read.is_control(i) or read.is_unknown(i) or read.is_unused(i))]
        self.id = {self.text[i]: i for i in plain}
        #: The lexicon's automaton: each state with the arcs that end on the way to it, shortest first. A sign that is no
        #: piece is an arc, too.
        self.states: dict[str, tuple[str, ...]] = {}
        for p in sorted(self.id):
            for n in range(1, len(p) + 1):
                if (state := p[:n]) not in self.states:
                    self.states[state] = self.states.get(p[: n - 1], ()) + ((state,) if n == 1 or state in self.id else ())
        self.longest = max(map(len, self.id), default=1)
        self.inside = {p[i : i + 2] for p in self.id for i in range(len(p) - 1)}
        self.cost = {p: -self.score[i] for p, i in self.id.items()}
        #: The number of each sign that has neighbours inside pieces, 0 for all others; whether two numbers are neighbours.
        signs = sorted({sign for pair in self.inside for sign in pair})
        self._number = np.zeros(sys.maxunicode + 1, np.int32)
        self._number[[ord(sign) for sign in signs]] = np.arange(1, len(signs) + 1)
        self._joined = np.zeros((len(signs) + 1, len(signs) + 1), bool)
        for left, right in self.inside:
            self._joined[self._number[ord(left)], self._number[ord(right)]] = True
        self._bytes = pa.array([bytes([self.byte_of[i]]) if i in self.byte_of else t.encode() for i, t in enumerate(self.text)], pa.large_binary())
        self.forget()

    def forget(self) -> None:
        """Empty the tables of what has been worked out; they hold nothing that a later text would not fill again."""
        self._known = _Known(self._stretch)
        self._older: dict[bytes, tuple[int, ...]] = {}
        #: Weights of pairs already worked out, by the first piece; the empty one stands for the start.
        self._pairs: dict[str, dict[str, bool]] = {}
        self._known_pairs = 0

    # the bigram acceptor

    def _merged(self, text: str) -> list[str]:
        """Merge the best pair first, the leftmost of equals. Only ever asked of a piece or two."""
        parts, get, none = list(text), self.cost.get, math.inf
        costs = [get(a + b, none) for a, b in zip(parts, parts[1:])]
        while costs and (best := min(costs)) < none:
            i = costs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del costs[i]
            if i:
                costs[i - 1] = get(parts[i - 1] + parts[i], none)
            if i < len(costs):
                costs[i] = get(parts[i] + parts[i + 1], none)
        return parts

    def follows(self, left: str, right: str) -> bool:
        """Whether the weight of the pair is zero: the merges of ``left + right`` end in these two."""
        if self._known_pairs > 4 * _KEPT:
            self._pairs.clear()
            self._known_pairs = 0
        self._known_pairs += 1
        out = self._pairs.setdefault(left, {})[right] = self._merged(left + right) == [left, right]
        return out

    # composition and shortest path

    def _arcs(self, text: str, i: int) -> tuple[str, ...]:
        """The pieces that start at a place, shortest first; a sign outside the lexicon is its own arc. With a state all those
        on the way to it are there, so the last state is found by halving the number of signs."""
        states, least, most = self.states, 1, min(self.longest, len(text) - i)
        while least < most:
            n = (least + most + 1) >> 1
            if text[i : i + n] in states:
                least = n
            else:
                most = n - 1
        start = text[i : i + least]
        return states.get(start) or (start,)

    def _path(self, text: str) -> list[str]:
        """The shortest path through the lattice. In a merge model, whose paths weigh zero or infinity, that is the
        first path found depth first, longest arcs first; a state (place, last piece) with no way on is left for
        good, so each is entered once."""
        if not self.merges:
            return self._cheapest(text)
        n, at, last = len(text), 0, ""
        path: list[str] = []
        untried: list[tuple[tuple[str, ...], int]] = []
        lost: set[tuple[int, str]] = set()
        arcs = self._arcs(text, 0)
        k = len(arcs)
        while True:
            fit = self._pairs.get(last) or {}
            while k:
                k -= 1
                piece = arcs[k]
                if lost and (at, piece) in lost:
                    continue
                fits = fit.get(piece)
                if fits is None:
                    fits = self.follows(last, piece) if last else self._stands(piece)
                if fits:
                    break
            else:  # no way on from here
                last = path.pop()
                at -= len(last)
                lost.add((at, last))
                last = path[-1] if path else ""
                arcs, k = untried.pop()
                continue
            path.append(piece)
            at += len(piece)
            if at == n:
                return path
            untried.append((arcs, k))
            last = piece
            arcs = self._arcs(text, at)
            k = len(arcs)

    def _stands(self, piece: str) -> bool:
        out = self._pairs.setdefault("", {})[piece] = len(piece) == 1 or self._merged(piece) == [piece]
        return out

    def _cheapest(self, text: str) -> list[str]:
        n = len(text)
        worst = max(self.cost.values(), default=0.0) + 10.0  # an arc of byte fallback
        best: list[tuple[float, str | None]] = [(0.0, None)] + [(math.inf, None)] * n
        for i in range(n):
            for piece in self._arcs(text, i):
                c, j = best[i][0] + self.cost.get(piece, worst), i + len(piece)
                if c < best[j][0]:
                    best[j] = c, piece
        out: list[str] = []
        while n:
            piece = best[n][1]
            out.append(piece)
            n -= len(piece)
        return out[::-1]

    def _ids(self, path: list[str]) -> tuple[int, ...]:
        try:
            return tuple([self.id[piece] for piece in path])
        except KeyError:
            pass
        out: list[int] = []
        for piece in path:
            i = self.id.get(piece)
            if i is not None:
                out.append(i)
            elif self.byte:
                out += [self.byte[b] for b in piece.encode("utf-8", "surrogatepass")]
            else:
                out.append(self.unknown)
        return tuple(out)

    def _stretch(self, stretch: bytes) -> tuple[int, ...]:
        """Ids of a stretch that holds no cut. Of two generations of known ones the older goes."""
        found = self._older.get(stretch)
        if found is None:
            found = self._ids(self._path(stretch.decode("utf-8", "surrogatepass")))
        if len(stretch) <= 64:
            if len(self._known) > _KEPT:
                self._older = dict(self._known)
                self._known.clear()  # encode_all() goes on with this one
            self._known[stretch] = found
        return found

    def _starts(self, signs: np.ndarray) -> np.ndarray:
        """The places where a stretch starts, but for the first."""
        found = []
        for a in range(0, len(signs), _SIGNS):
            n = self._number[signs[a : a + _SIGNS + 1]]
            found.append(np.flatnonzero(~self._joined[n[:-1], n[1:]]) + a + 1)
        return np.concatenate(found)

    def normal(self, text: str) -> str:
        """The normaliser's output but for the meta sign in front; meta signs stand for spaces."""
        if self.rules or self.squeezed:
            text = self._rewritten(text)
        return text.replace(" ", META)

    def _rewritten(self, text: str) -> str:
        out: list[str] = []
        rules, lengths, squeezed = self.rules, self.rule_lengths, self.squeezed
        i, after_space = 0, squeezed
        while i < len(text):
            part, step = text[i], 1
            for n in range(lengths.get(part, 0), 0, -1):
                found = rules.get(text[i : i + n])
                if found is not None:
                    part, step = found, min(n, len(text) - i)
                    break
            i += step
            if after_space:
                part = part.lstrip(" ")
            if part:
                out.append(part)
                after_space = squeezed and part[-1] == " "
        joined = "".join(out)
        return joined.rstrip(" " + META) if squeezed else joined

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each text end, after a zero, and the ids of all; none for a null or empty text."""
        normal = [self.normal(t) if t else "" for t in texts]
        whole = [self.prefix + t if t else "" for t in normal]
        ends = np.cumsum([0, *map(len, whole)])
        signs = np.frombuffer("".join(whole).encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(signs):
            return np.zeros(len(texts) + 1, np.int64), np.empty(0, np.int32)
        first = np.zeros(len(signs) + 1, bool)
        first[self._starts(signs)] = True
        first[ends] = True
        starts = np.flatnonzero(first)
        data = "".join(whole).encode("utf-8", "surrogatepass")
        places = np.zeros(len(signs) + 1, np.int64)
        np.cumsum(1 + (signs > 0x7F).astype(np.int8) + (signs > 0x7FF) + (signs > 0xFFFF), out=places[1:])
        stretches = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(places[starts]), pa.py_buffer(data)]).dictionary_encode()
        found = list(map(self._known.__getitem__, stretches.dictionary.to_pylist()))
        lists = pa.ListArray.from_arrays(
            np.cumsum([0, *map(len, found)], dtype=np.int32), np.fromiter(chain.from_iterable(found), np.int32)
        ).take(stretches.indices)
        ids = lists.flatten().to_numpy(zero_copy_only=False)
        return lists.offsets.to_numpy()[np.searchsorted(starts, ends)].astype(np.int64), ids

    def decode_all(self, ends: np.ndarray, ids: np.ndarray) -> pa.Array:
        """The texts of ids that ``encode_all`` gave, whose bytes are whole signs."""
        taken = self._bytes.take(pa.array(ids))
        places = np.frombuffer(taken.buffers()[1], np.int64)[ends]
        joined = pa.Array.from_buffers(pa.large_string(), len(ends) - 1, [None, pa.py_buffer(places), taken.buffers()[2]])
        plain = pc.replace_substring(joined, META, " ")
        return (pc.if_else(pc.starts_with(plain, " "), pc.utf8_slice_codeunits(plain, 1), plain) if self.prefix else plain).cast(pa.string())

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for a null or empty one."""
        return self.encode_all([text])[1].tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become the replacement sign."""
        text, byte_of = self.text, self.byte_of
        if byte_of.keys().isdisjoint(ids):
            joined = "".join(map(text.__getitem__, ids))
        else:
            parts, held = [], bytearray()
            for i in ids:
                if i in byte_of:
                    held.append(byte_of[i])
                    continue
                if held:
                    parts.append(held.decode("utf-8", "replace"))
                    held = bytearray()
                parts.append(text[i])
            parts.append(held.decode("utf-8", "replace"))
            joined = "".join(parts)
        plain = joined.replace(META, " ")
        return plain[1:] if self.prefix and plain[:1] == " " else plain


@cache
def compiled(model: bytes) -> Transducer:
    return Transducer(model)


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows that hold some ``_SIGNS`` signs at most, or one row."""
    upto = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + _SIGNS, "right")))
        yield batch.slice(a, b - a)
        a = b


def encode(docs: DataFrame, model_file: str, decoded: bool = True) -> DataFrame:
    """``(doc_id, n_tokens, ids)`` of every whole text and, if asked for, ``decoded``, the text that the ids give.

    A null or empty text has no ids and decodes to an empty text; texts of any length are encoded whole, in time that
    grows with their length. Repeated rows and ids each give their row, an empty table gives none, and further columns,
    whatever their names, are not read. ``model_file`` is read on the driver; its bytes, of a fixed size, go to the
    executors. Ids equal the library's.
    """
    with open(model_file, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(shared.value)
        machine.forget()  # a worker that goes on to other work should not keep the last task's stretches
        for whole in batches:
            for batch in _parts(whole):
                ends, ids = machine.encode_all(batch.column(1).to_pylist())
                columns = [batch.column(0), pa.array(np.diff(ends)), pa.ListArray.from_arrays(ends.astype(np.int32), ids)]
                names = ["doc_id", "n_tokens", "ids"]
                if decoded:
                    columns.append(machine.decode_all(ends, ids))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(columns, names)
        machine.forget()

    schema = "doc_id long, n_tokens long, ids array<int>" + ", decoded string" * decoded
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def op10_sentencepiece(spark, sf_dir: str, model_file: str = MODEL) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), model_file)
