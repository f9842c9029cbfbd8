"""SentencePiece encoding and decoding: a streaming Viterbi search whose survivors are the model's own merges.

The public model is of the BPE kind: its encoding is not the path of the highest sum of scores. But of the pieces that
may end at a position exactly one can follow the encoding of what lies before: the one that merging, run on the two
neighbouring pieces alone, leaves as it is. So the search keeps one survivor for each boundary, like any Viterbi search,
with that test in place of a sum, and its ids are those of the model's own encoder.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import keep_memory, lean, prepare

MODEL = os.environ.get("HAPLOWEAVE_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
SPACE = "▁"
#: Stands for a literal U+2581 of a text, which must not turn into a space: no valid text and no piece holds it.
_LITERAL = "\ud800"
#: Types of pieces in the model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


_LONE = (-1, {})


class Pieces:
    """Pieces of a model with byte fallback: what the encoder and the decoder need."""

    def __init__(self, model: bytes) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        self.ids: dict[str, tuple[int, float]] = {}
        self.texts: list[str] = [p.piece for p in proto.pieces]
        self.bytes_: list[bytes] = []
        byte_ids: dict[int, int] = {}
        for i, p in enumerate(proto.pieces):
            text = b""
            if p.type in (NORMAL, USER_DEFINED, UNUSED):
                text = p.piece.replace(SPACE, " ").encode()
                if p.type != UNUSED:
                    self.ids[p.piece] = (i, p.score)
            elif p.type == BYTE:
                byte_ids[value := int(p.piece[3:5], 16)] = i
                text = bytes([value])
            self.bytes_.append(text)
        if len(byte_ids) != 256:
            raise ValueError("the model has no byte fallback")
        self.byte_ids = [byte_ids[b] for b in range(256)]
        self.longest = max(map(len, self.ids))
        #: A trie over the pieces: character -> [id or -1, the same for what may follow].
        self.trie: dict[str, list] = {}
        for p, (i, _) in self.ids.items():
            node: list = [-1, self.trie]
            for char in p:
                node = node[1].setdefault(char, [-1, {}])
            node[0] = i
        #: Characters that stand side by side in a piece: merging goes over no other boundary.
        self.inner = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        #: What stable() said, by ids: left * 2**21 + right (left -1: start or no piece, which merge with nothing).
        self.tested: dict[int, bool] = {}
        #: Characters other than letters that some piece holds right after a letter.
        self.late = "".join(sorted({p[1] for p in self.inner if p[0].isalpha() and not p[1].isalpha() and not p[1].isspace() and p[1] != SPACE}))
        self.prefix = proto.normalizer_spec.add_dummy_prefix
        # No piece goes on with a space mark after another character: then a search may start anew before each run of marks.
        self.cuts_at_space = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        self.lone_newline = not any("\n" in p for p in self.ids if len(p) > 1)

    def merge(self, text: str, border: int = 0) -> list[str] | None:
        """Merging as the model defines it: of the neighbours whose union is a piece the best by score first, then from
        the left. None as soon as a union goes over the border."""
        parts, starts, find = list(text), list(range(len(text))), self.ids.get
        joins = [find(a + b) for a, b in zip(parts, parts[1:], strict=False)]
        while True:
            best, at = None, -1
            for i, found in enumerate(joins):
                if found is not None and (best is None or found[1] > best):
                    best, at = found[1], i
            if at < 0:
                return parts
            if starts[at + 1] == border:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del starts[at + 1], joins[at]
            if at:
                joins[at - 1] = find(parts[at - 1] + parts[at])
            if at < len(joins):
                joins[at] = find(parts[at] + parts[at + 1])

    def stable(self, left: str, right: str) -> bool:
        """Whether merging leaves these two neighbours as they are. (The empty text is before a stream's first piece.)"""
        if left and left[-1] + right[0] in self.inner:
            return self.merge(left + right, len(left)) == [left, right]
        return len(right) == 1 or self.merge(right) == [right]

    def fallback(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in (SPACE if char == _LITERAL else char).encode()]


class StreamingViterbi:
    """The encoding of a stream of characters, in memory bounded by where the surviving paths converge.

    feed() takes characters and gives the ids that no later character can change; finish() gives the rest. Each boundary
    keeps one survivor: a piece and the boundary before it. A boundary is expanded once the window behind it holds the
    longest piece (or the stream ended). Ids are committed as soon as the backpointers of all open ends share a
    boundary: up to the present one where no piece crosses it, else, looked for every CHECK characters, up to the last
    shared one; then the window begins there.
    """

    CHECK = 32

    def __init__(self, pieces: Pieces) -> None:
        self.pieces, self.window = pieces, ""
        #: For each boundary of the window the start of the piece that ends there, and its id; start -1: none yet.
        self.back: list[int] = [0]
        self.piece = [-1]
        #: The boundary to expand next, the last end reached, the largest window, and the ids committed so far.
        self.at, self.reach, self.peak, self.committed = 0, 0, 0, 0

    def _ids(self, end: int) -> list[int]:
        """Ids of the surviving path to a boundary."""
        out: list[int] = []
        back, piece = self.back, self.piece
        while end > 0:
            if piece[end] >= 0:
                out.append(piece[end])
            else:
                out.extend(reversed(self.pieces.fallback(self.window[back[end] : end])))
            end = back[end]
        out.reverse()
        return out

    def _commit(self, end: int) -> list[int]:
        out = self._ids(end)
        self.committed += len(out)
        self.peak = max(self.peak, self.at)
        self.window = self.window[end:]
        self.back, self.piece = [0, *(b - end for b in self.back[end + 1 :])], self.piece[end:]
        self.at, self.reach = self.at - end, self.reach - end
        return out

    def _shared(self) -> int:
        """The last boundary on the paths to all open ends."""
        ends = {e for e in range(self.at, self.reach + 1) if self.back[e] >= 0 or e == 0}
        while len(ends) > 1:
            last = max(ends)
            ends.remove(last)
            ends.add(self.back[last])
        return ends.pop()

    def _run(self, room: int) -> list[int]:
        out: list[int] = []
        text, trie, back, piece = self.window, self.pieces.trie, self.back, self.piece
        tested, stable = self.pieces.tested, self.pieces.stable
        at, reach, size = self.at, self.reach, len(self.window)
        while at + room <= size and at < size:
            left, end, follow = piece[at] << 21, at, trie
            while end < size:
                node = follow.get(text[end])
                if node is None:
                    break
                arc, follow = node
                end += 1
                if arc >= 0 and (end > reach or back[end] < 0):
                    ok = tested.get(left + arc)
                    if ok is None:
                        if len(tested) >= 400_000:
                            tested.clear()
                        ok = tested[left + arc] = stable(self.pieces.texts[left >> 21] if left >= 0 else "", self.pieces.texts[arc])
                    if ok:
                        while reach < end:
                            reach += 1
                            back.append(-1)
                            piece.append(-1)
                        back[end], piece[end] = at, arc
            if reach == at:  # a character that is no piece stands alone
                reach += 1
                back.append(at)
                piece.append(-1)
            elif back[at + 1] < 0 and trie.get(text[at], _LONE)[0] < 0:
                back[at + 1] = at
            at += 1
            if reach == at and (at == size or at >= self.CHECK // 2) or at % self.CHECK == 0:
                self.at, self.reach = at, reach
                end = at if reach == at else self._shared()
                if end > 0:
                    out += self._commit(end)
                    text, back, piece, at, reach, size = self.window, self.back, self.piece, self.at, self.reach, len(self.window)
        self.at, self.reach = at, reach
        return out

    def feed(self, text: str) -> list[int]:
        self.window += text
        return self._run(self.pieces.longest)

    def finish(self) -> list[int]:
        return self._run(1)


class _Committed(dict):
    """Stretch -> its ids as bytes: what the search committed, in two generations of at most ROOM; long ones aren't kept."""

    ROOM, SHORT = 250_000, 64

    def __init__(self, search: Callable[[str], array]) -> None:
        self.search, self.older = search, {}

    def __missing__(self, stretch: str) -> bytes:
        ids = self.older.get(stretch)
        if ids is None:
            ids = self.search(stretch).tobytes()
        if len(stretch) <= self.SHORT:
            if len(self) >= self.ROOM:
                self.older = dict(self)
                self.clear()
            self[stretch] = ids
        return ids


class Codec:
    """Encodes and decodes whole texts by the streaming search.

    A boundary that no piece can cross is one where all paths converge, whatever stands around it: the search commits
    there and goes on as a new one. What it committed between two such boundaries is remembered, so that the same
    stretch need not be searched again. Every id comes from the search; `searched` counts the characters it went over.
    """

    def __init__(self, model: bytes) -> None:
        self.pieces = Pieces(model)
        self.searched = 0
        self.committed = _Committed(self._search)
        # Merging stops before spaces, around lone line breaks, and between a letter and most other characters. What may
        # follow a letter in a piece takes all marks after it along.
        stop = "\\n" if self.pieces.lone_newline else ""
        mark = f"(?:(?![ {stop}])[\\W\\d_])"
        word = r"[^\W\d_]+" + (f"(?:[{re.escape(self.pieces.late)}]{mark}*)?" if self.pieces.late else "")
        parts = f"{stop and stop + '|'} *(?:{mark}+(?:{word})*|(?:{word})+)| +"
        self.stretches = re.compile(parts).findall if self.pieces.cuts_at_space else lambda text: [text]

    def _search(self, stretch: str) -> array:
        """The stream over one stretch, fed in bounded steps."""
        stream = StreamingViterbi(self.pieces)
        stretch = stretch.replace(SPACE, _LITERAL).replace(" ", SPACE)
        self.searched += len(stretch)
        if len(stretch) <= 256:
            stream.window = stretch
            return array("i", stream.finish())
        out = array("i")
        for i in range(0, len(stretch), 256):
            out.extend(stream.feed(stretch[i : i + 256]))
        out.extend(stream.finish())
        return out

    def encode(self, text: str, out: array) -> None:
        """Append the ids of text to out; an empty text has none."""
        if not text:
            return
        out.frombytes(b"".join(map(self.committed.__getitem__, self.stretches(" " + text if self.pieces.prefix else text))))

    def decode(self, ids: list[int] | np.ndarray) -> str:
        raw = b"".join(map(self.pieces.bytes_.__getitem__, ids))
        return (raw[1:] if self.pieces.prefix and raw[:1] == b" " else raw).decode("utf-8", "replace")


_codecs: dict[bytes, Codec] = {}


keep_memory("pieces", _codecs.clear)


def _codec(model: bytes) -> Codec:
    """One codec for each model and Python process: what it remembers serves the next task too, until another operator's
    task needs the memory."""
    key = hashlib.sha256(model).digest()
    if key not in _codecs:
        _codecs[key] = Codec(model)
    return _codecs[key]


def encode(docs: DataFrame, model: str = MODEL, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs -> keep columns, ids array<int>, n_ids long, decoded boolean (decoding the ids gives the whole text again).

    No shuffle; one row per row, repeated rows and null ids too. Null text counts as empty: no ids, decoded. The model
    file is read on the driver and sent along (its size is that of a vocabulary). A literal U+2581 goes by bytes.
    """
    prepare(docs.sparkSession)
    with open(model, "rb") as f:
        held = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(held)
        table = codec.pieces.bytes_.__getitem__
        for batch in batches:
            lo, texts = 0, batch.column(len(keep))
            while lo < batch.num_rows:
                hi, size, out, ends, decoded = lo, 0, array("i"), [0], []
                while hi < batch.num_rows and (size < 2 << 20 or hi == lo):
                    text = texts[hi].as_py() or ""
                    codec.encode(text, out)
                    raw = b"".join(map(table, out[ends[-1] :]))
                    decoded.append(raw == ((b" " if codec.pieces.prefix and text else b"") + text.encode()))
                    ends.append(len(out))
                    size, hi = size + len(text), hi + 1
                offsets = np.array(ends, dtype=np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(out, dtype=np.int32)))
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], ids, pa.array(np.diff(offsets).astype(np.int64)), pa.array(decoded)], names=[*keep, "ids", "n_ids", "decoded"])
                lo = hi

    picked = docs.select(*keep, "text")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1]), "ids array<int>, n_ids long, decoded boolean"])
    return picked.mapInArrow(lean(run, "pieces"), schema)


def decode(encoded: DataFrame, model: str = MODEL, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """encoded(keep columns, ids, ...) -> keep columns, text. Null ids give an empty text; an id outside the model fails."""
    prepare(encoded.sparkSession)
    with open(model, "rb") as f:
        held = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(held)
        for batch in batches:
            made = [codec.decode(x.values.to_numpy(zero_copy_only=False).tolist()) if x.is_valid else "" for x in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(made, pa.string())], names=[*keep, "text"])

    picked = encoded.select(*keep, "ids")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1]), "text string"])
    return picked.mapInArrow(lean(run, "pieces"), schema)
