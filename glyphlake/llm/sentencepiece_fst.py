"""SentencePiece encoding and decoding as shortest paths of weighted transducers.

Three transducers are compiled from a model file. ``Normaliser`` rewrites strings of the character map (read
from its double array; leftmost, longest first), squeezes and escapes white space and puts the dummy prefix
in front. ``Pieces`` is a prefix tree whose final states emit a piece's number with its weight. Byte fallback
has one arc for each character that no piece covers; it emits the bytes' pieces, or the unknown one.
Composed with an input string, the last two give a lattice: for each position the arcs that end there.
Encoding is the lattice's shortest path in the tropical semiring (min, +).

Weights. In a unigram model a piece weighs minus its log-probability, and every sequence of pieces is
accepted. In a BPE model a piece weighs one, and the lattice is composed with ``Adjacent``, the acceptor of
sequences that the model's merges leave apart: merges inside the pieces of a correct encoding never touch
each other, so a sequence is the model's encoding exactly if each adjacent pair is its own encoding, and
one path of finite weight remains for each prefix. The acceptor's arcs are found from the merges when first
met, and kept.

Words repeat, so shortest paths are kept for whole chunks: no piece joins a character to a following
word mark or newline (checked when the model is compiled), and so chunks cut there encode on their own.
What a Python worker keeps is bounded (KEPT_CHUNKS, KEPT_PAIRS), so its memory doesn't grow with the input.

Defined cases: null gives null; an empty text gives no pieces; every other text decodes to itself if the
model keeps extra white space and has no character map (a word mark U+2581 in the text decodes to a blank, as
in the library); repeated rows encode alike; texts are never truncated; an empty table gives an empty
result; a chunk without a path of finite weight (a BPE model whose pieces its merges can't reach) gets what
the merges leave; word and character models are refused when compiled.
"""

from __future__ import annotations

import hashlib
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import mapped_rows, without

MARK = "\u2581"
#: What a Python worker keeps: chunks with their shortest paths, and arcs of the acceptor of adjacent pieces.
KEPT_CHUNKS = 100_000
#: As many where nothing else of the job needs the memory.
MANY_CHUNKS, MANY_PAIRS = 400_000, 1_000_000
KEPT_PAIRS = 200_000
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
INFINITE = float("inf")


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def _fields(data: bytes):
    """(number, value) of the fields of a protocol buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 1:
            value, at = data[at : at + 8], at + 8
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        elif kind == 5:
            value, at = data[at : at + 4], at + 4
        else:
            raise ValueError("not a SentencePiece model")
        yield key >> 3, value


class PieceModel:
    """What a .model file says: pieces (text, score, kind), the algorithm, and the normaliser's settings."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.fallback, self.prefix, self.squeeze, self.escape, self.rules = UNIGRAM, False, True, True, True, b""
        for field, value in _fields(data):
            if field == 1:
                piece = dict(_fields(value))
                score = float(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0])
                self.pieces.append((piece[1].decode(), score, piece.get(3, NORMAL)))
            elif field == 2:
                spec = dict(_fields(value))
                self.kind, self.fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
            elif field == 3:
                spec = dict(_fields(value))
                self.rules = spec.get(2, b"")
                self.prefix, self.squeeze, self.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("word and character models have no lattice of pieces")


def character_map(data: bytes) -> dict[str, str]:
    """The rewrites of a precompiled character map: a double array over UTF-8 bytes, then the targets, each ended by a zero."""
    if not data:
        return {}
    size = int.from_bytes(data[:4], "little")
    units, targets = np.frombuffer(data[4 : 4 + size], "<u4"), data[4 + size :]
    labels = np.arange(1, 256, dtype=np.uint32)
    found, stack = {}, [(0, b"")]
    while stack:
        at, source = stack.pop()
        unit = int(units[at])
        base = at ^ ((unit >> 10) << ((unit & 512) >> 6))
        if unit >> 8 & 1:
            start = int(units[base]) & 0x7FFFFFFF
            found[source.decode("utf-8", "replace")] = targets[start : targets.index(b"\0", start)].decode()
        places = base ^ labels
        inside = places < len(units)
        hit = inside.copy()
        hit[inside] = (units[places[inside]] & 0x800000FF) == labels[inside]
        stack += [(int(x), source + bytes([int(c)])) for x, c in zip(places[hit], labels[hit])]
    return found


class Normaliser:
    """The transducer from raw to normalised strings: rewriting arcs by their source, identity arcs for all else."""

    def __init__(self, model: PieceModel):
        self.model = model
        rules = {k: v for k, v in character_map(model.rules).items() if k and k != v}
        self.single = {ord(k): v for k, v in rules.items() if len(k) == 1}
        self.tree: dict = {}
        for source, target in rules.items():
            node = self.tree
            for c in source:
                node = node.setdefault(c, {})
            node[""] = target
        self.long = any(len(k) > 1 for k in rules)

    def rewritten(self, text: str) -> str:
        if not self.long:
            return text.translate(self.single) if self.single else text
        out, at = [], 0
        while at < len(text):
            node, end, last = self.tree, at, (text[at], at + 1)
            while end < len(text) and (node := node.get(text[end])) is not None:
                end += 1
                if "" in node:
                    last = (node[""], end)
            out.append(last[0])
            at = last[1]
        return "".join(out)

    def apply(self, text: str) -> str:
        text = self.rewritten(text)
        if self.model.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        if self.model.prefix:
            text = " " + text
        return text.replace(" ", MARK) if self.model.escape else text


class Pieces:
    """The transducer from strings to piece numbers, with byte fallback; the label of a character without a piece is -1 minus its code point."""

    def __init__(self, model: PieceModel):
        self.ids = {text: k for k, (text, _, kind) in enumerate(model.pieces) if kind in (NORMAL, USER)}
        scores = {k: -model.pieces[k][1] for k in self.ids.values()}
        self.weights = scores if model.kind == UNIGRAM else dict.fromkeys(scores, 1.0)
        self.fallback_weight = max(scores.values(), default=0.0) + 10.0 if model.kind == UNIGRAM else 1.0
        self.unknown = next((k for k, p in enumerate(model.pieces) if p[2] == UNKNOWN), 0)
        self.bytes = {int(p[0][3:5], 16): k for k, p in enumerate(model.pieces) if p[2] == BYTE}
        self.fallback = model.fallback and len(self.bytes) == 256
        self.texts = {k: text for text, k in self.ids.items()}
        # pieces read backwards, to find those that end somewhere: character -> [label or None, further characters or None]
        self.tree: dict = {}
        for text, k in self.ids.items():
            below, node = self.tree, None
            for c in reversed(text):
                if node is not None:
                    if node[1] is None:
                        node[1] = {}
                    below = node[1]
                node = below.setdefault(c, [None, None])
            node[0] = k

    def into(self, text: str, end: int) -> list[int]:
        """The lattice's arcs that end at a position of the string, as start, label, start, label and so on, the shortest first."""
        at = end - 1
        node = self.tree.get(text[at])
        if node is None:
            return [at, -1 - ord(text[at])]
        label, below = node
        arcs = [at, -1 - ord(text[at]) if label is None else label]
        while below is not None and at:
            node = below.get(text[at - 1])
            if node is None:
                break
            at -= 1
            label, below = node
            if label is not None:
                arcs += (at, label)
        return arcs

    def text(self, label: int) -> str:
        return self.texts[label] if label >= 0 else chr(-1 - label)

    def output(self, labels: list[int]) -> list[int]:
        """Piece numbers of a path; characters without a piece become bytes, or a run of them one unknown piece."""
        if min(labels, default=0) >= 0:
            return labels
        out: list[int] = []
        lost = False
        for label in labels:
            if label >= 0:
                out.append(label)
            elif self.fallback:
                out += [self.bytes[b] for b in chr(-1 - label).encode()]
            elif not lost:
                out.append(self.unknown)
            lost = label < 0
        return out


class Adjacent:
    """The acceptor of sequences whose adjacent pieces the merges of a BPE model leave apart; a state is the last label."""

    START, WIDE = 1 << 30, 1 << 22

    def __init__(self, pieces: Pieces, model: PieceModel):
        self.pieces = pieces
        self.scores = {text: model.pieces[k][1] for text, k in pieces.ids.items()}
        self.kept: dict[int, bool] = {}
        self.most = KEPT_PAIRS

    def merged(self, text: str) -> list[str]:
        """The merges of a BPE model on a short string: best score first, leftmost among equals."""
        parts = list(text)
        score = self.scores.get
        joins = [score(a + b, -INFINITE) for a, b in zip(parts, parts[1:])]
        while joins and (best := max(joins)) > -INFINITE:
            k = joins.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del joins[k]
            if k:
                joins[k - 1] = score(parts[k - 1] + parts[k], -INFINITE)
            if k < len(joins):
                joins[k] = score(parts[k] + parts[k + 1], -INFINITE)
        return parts

    def accepts(self, before: int, label: int) -> bool:
        """Whether there is an arc with the label from the state ``before``; kept under before * WIDE + label."""
        if len(self.kept) >= self.most:
            self.kept.clear()
        pair = [self.pieces.text(x) for x in (before, label) if x != self.START]
        found = self.kept[before * self.WIDE + label] = self.merged("".join(pair)) == pair
        return found


def shortest_path(text: str, pieces: Pieces, adjacent: Adjacent | None) -> list[int] | None:
    """Labels of the lattice's shortest path in (min, +), None if all weigh infinitely much.

    A state is a position, with the label before it where an acceptor of adjacent pieces is composed; it leaves
    one label of finite weight for each position, so the first arc that it accepts decides, and longer pieces
    are tried first.
    """
    size = len(text)
    if adjacent:
        back, last = [0] * (size + 1), [None] * (size + 1)
        last[0] = adjacent.START
        known, accepts, wide, tree = adjacent.kept.get, adjacent.accepts, adjacent.WIDE, pieces.tree.get
        for end, c in enumerate(text, 1):
            # as ``into``, in place: this is where the time goes
            at = end - 1
            node = tree(c)
            if node is None:
                arcs = [at, -1 - ord(c)]
            else:
                label, below = node
                arcs = [at, -1 - ord(c) if label is None else label]
                while below is not None and at:
                    at -= 1
                    node = below.get(text[at])
                    if node is None:
                        break
                    label, below = node
                    if label is not None:
                        arcs += (at, label)
            while arcs:
                label, at = arcs.pop(), arcs.pop()
                before = last[at]
                if before is None:
                    continue
                apart = known(before * wide + label)
                if apart is None:
                    apart = accepts(before, label)
                if apart:
                    back[end], last[end] = at, label
                    break
        reached = last[size] is not None
    else:
        cost, back, last = [INFINITE] * (size + 1), [0] * (size + 1), [0] * (size + 1)
        cost[0] = 0.0
        into, weight, other = pieces.into, pieces.weights.get, pieces.fallback_weight
        for end in range(1, size + 1):
            arcs = into(text, end)
            while arcs:
                label, at = arcs.pop(), arcs.pop()
                total = cost[at] + weight(label, other)
                if total < cost[end]:
                    cost[end], back[end], last[end] = total, at, label
        reached = cost[size] < INFINITE
    if not reached:
        return None
    at, out = size, []
    while at:
        out.append(last[at])
        at = back[at]
    out.reverse()
    return out


class Transducer:
    """A compiled model: normaliser, pieces and byte fallback, and for BPE the acceptor of adjacent pieces."""

    def __init__(self, data: bytes):
        model = self.model = PieceModel(data)
        self.normaliser, self.pieces = Normaliser(model), Pieces(model)
        self.adjacent = Adjacent(self.pieces, model) if model.kind == BPE else None
        apart = all(MARK not in text.lstrip(MARK) and "\n" not in text for text in self.pieces.ids)
        self.chunk = re.compile(rf"{MARK}*[^{MARK}\n]+|{MARK}+|\n+" if apart and self.pieces.fallback else r"[\s\S]+")
        self.most = KEPT_CHUNKS
        self.kept = _Chunks(self)
        self.out = self._outputs()

    def path(self, chunk: str) -> list[int]:
        labels = shortest_path(chunk, self.pieces, self.adjacent)
        if labels is None:
            labels = [self.pieces.ids.get(x, -1 - ord(x[0])) for x in self.adjacent.merged(chunk)]
        return self.pieces.output(labels)

    def allow(self, chunks: int, pairs: int) -> None:
        """How many paths and arcs may be kept."""
        self.most = chunks
        if self.adjacent:
            self.adjacent.most = pairs

    def forget(self) -> None:
        """Drop all kept paths and arcs."""
        self.kept = _Chunks(self)
        if self.adjacent:
            self.adjacent.kept = {}

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.kept.__getitem__, self.chunk.findall(self.normaliser.apply(text)))), np.int32)

    def _outputs(self) -> list[bytes]:
        out = []
        for text, _, kind in self.model.pieces:
            if kind in (NORMAL, USER):
                out.append((text.replace(MARK, " ") if self.model.escape else text).encode())
            elif kind == BYTE:
                out.append(bytes([int(text[3:5], 16)]))
            else:
                out.append(" \u2047 ".encode() if kind == UNKNOWN else b"")
        return out

    def decode(self, ids) -> str:
        data = b"".join(map(self.out.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))
        if self.model.prefix and data[:1] == b" ":
            data = data[1:]
        return data.decode("utf-8", "replace")


class _Chunks(dict):
    """Shortest paths by chunk, as packed 32-bit numbers: those met lately, and those of the round before them that weren't met since."""

    def __init__(self, fst: Transducer):
        super().__init__()
        self.fst, self.before = fst, {}

    def __missing__(self, chunk: str) -> bytes:
        found = self.before.pop(chunk, None)
        if found is None:
            found = array("i", self.fst.path(chunk)).tobytes()
        if len(chunk) <= 64:
            if len(self) >= self.fst.most:
                self.before = dict(self)
                self.clear()
            self[chunk] = found
        return found


_COMPILED: dict[bytes, Transducer] = {}


def transducer(model: bytes | str) -> Transducer:
    """The compiled model (a file's bytes, or its path), once for each Python worker."""
    data = read_model(model) if isinstance(model, str) else model
    key = hashlib.sha256(data).digest()
    if key not in _COMPILED:
        _COMPILED.clear()
        _COMPILED[key] = Transducer(data)
    return _COMPILED[key]


def read_model(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def _lists(rows: list[np.ndarray | None]) -> pa.ListArray:
    sizes = np.array([0 if x is None else len(x) for x in rows])
    ends = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.concatenate([x for x in rows if x is not None] or [np.zeros(0, np.int32)]).astype(np.int32)
    starts = pa.array(ends.astype(np.int32), mask=np.array([x is None for x in rows] + [False]))
    return pa.ListArray.from_arrays(starts, pa.array(flat))


def encode_column(docs: DataFrame, model_path: str, text: str = "text", out: str = "ids", check: str | None = None, size: int = 256, forget: bool = False) -> DataFrame:
    """Replace ``text`` by its piece numbers; check: name of a boolean column, whether they decode to the text.

    The driver reads the model file and ships it with the job. Columns already named ``out`` or ``check``
    are replaced. Rows leave in batches of ``size``. forget: workers drop the
    paths they keep when a task ends, for jobs with other large stages behind. Equal texts in a row are encoded once.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(read_model(model_path))

    def run(batches, kept):
        fst = transducer(shipped.value)
        fst.allow(*((KEPT_CHUNKS, KEPT_PAIRS) if forget else (MANY_CHUNKS, MANY_PAIRS)))
        pa.default_memory_pool().release_unused()
        for whole in batches:
            for at in range(0, whole.num_rows, size):
                batch = whole.slice(at, size)
                texts = batch.column("_in").to_pylist()
                rows = []
                for k, x in enumerate(texts):
                    rows.append(rows[-1] if k and x == texts[k - 1] else None if x is None else fst.encode(x))
                columns = [*(batch.column(c) for c in kept), _lists(rows)]
                if check:
                    columns.append(pa.array([None if x is None else fst.decode(ids) == x for x, ids in zip(texts, rows)], pa.bool_()))
                yield pa.RecordBatch.from_arrays(columns, [*kept, "_ids", *(["_check"] if check else [])])
        if forget:
            fst.forget()
            pa.default_memory_pool().release_unused()

    names = [out, *([check] if check else [])]
    return mapped_rows(docs, without(docs, text, *names), text, run, "_ids array<int>" + (", _check boolean" if check else ""), names)


def decode_column(docs: DataFrame, model_path: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """Replace piece numbers by the text they stand for; null gives null."""
    shipped = docs.sparkSession.sparkContext.broadcast(read_model(model_path))

    def run(batches, kept):
        fst = transducer(shipped.value)
        for batch in batches:
            texts = [None if x is None else fst.decode(x) for x in batch.column("_in").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string())], [*kept, "_text"])

    return mapped_rows(docs, without(docs, ids, out), ids, run, "_text string", [out])


#: Rows handed to a Python task at once: whole texts are large, and the JVM holds such a batch twice.
BATCH_ROWS = 1000
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op5_sentencepiece(spark, sf_dir: str, model_path: str = DEFAULT_MODEL) -> DataFrame:
    # in a session of its own, set as the caller's is: rows are asked for later, and the caller's size of batches stays
    session = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(name):
            session.conf.set(name, value)
    session.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    docs = session.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = encode_column(docs, model_path, check="round_trip")
    return found.selectExpr("doc_id", "cast(size(ids) as bigint) as n_pieces", "ids", "round_trip")
