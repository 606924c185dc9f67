"""SentencePiece encoding and decoding by a weighted finite-state transducer.

A model file is compiled once on the driver into three machines:

- the normaliser: the model's character map as transition arrays (the double
  array that the file holds), and a table of two states for blanks;
- the pieces: a trie of transitions from character to state, with the piece id
  that a final state writes;
- byte fallback: from the trie's root, for a character that is no piece, an arc
  for each of its bytes.

They are composed with a text lazily, position by position. A state of the
composition is a position and, in a BPE model, the piece before it; states are
relaxed in the tropical semiring (min, +), and the path of least weight is the
text's encoding.

Weights: in a unigram model an arc weighs minus its piece's score, so the path
is the Viterbi segmentation. In a BPE model an arc weighs 0 if merging, done on
the characters of it and of the piece before it in order of score, would leave
exactly these two, else infinity. A segmentation is the one that BPE makes if
and only if each two neighbours pass, so one path of finite weight remains.
tests/llm compare both with an independent implementation.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thriftline.llm.common import shielded

META = "▁"
#: Piece types and model types of the public model format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
INF = float("inf")
#: Chunks (and parts of them) and pairs of pieces kept per Python worker, and the longest chunk that is kept.
MEMO_CHUNKS, MEMO_PAIRS, MEMO_CHARS = 260_000, 300_000, 48
UNKNOWN_PENALTY = 10.0
BATCH_ROWS = 500
#: Characters that a run of a character map may have.
MAP_CHARS = 64
BLANK_RUNS = re.compile(" +")


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and raw values of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, data[at : at + n]
            at += n


class CharMap:
    """A character map: from the longest run of bytes that it knows to what replaces them, by the transition arrays of the model file."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0]
        self.units = np.frombuffer(blob, dtype="<u4", count=size // 4, offset=4).tolist()
        self.texts = blob[4 + size :]
        self.first = re.compile("[" + "".join(map(re.escape, self._first_chars())) + "]") if self.units else None

    def step(self, state: int, byte: int) -> tuple[int, bool] | None:
        """The state after a byte, and whether a run of bytes may end there."""
        at = state ^ byte
        unit = self.units[at] if at < len(self.units) else 0
        if unit & 0x800000FF != byte:
            return None
        return at ^ (unit >> 10 << ((unit & 0x200) >> 6)), bool(unit >> 8 & 1)

    def root(self) -> int:
        return self.units[0] >> 10 << ((self.units[0] & 0x200) >> 6)

    def written(self, state: int) -> bytes:
        start = self.units[state] & 0x7FFFFFFF
        return self.texts[start : self.texts.index(b"\0", start)]

    def _first_chars(self) -> list[str]:
        """Characters that some run begins with."""
        found, open_ = [], [(self.root(), b"")] if self.units else []
        while open_:
            state, read = open_.pop()
            for byte in range(1, 256) if not read else range(0x80, 0xC0):
                if (next_ := self.step(state, byte)) is not None:
                    n = 1 if (read or bytes([byte]))[0] < 0x80 else 2 if (read or bytes([byte]))[0] < 0xE0 else 3 if (read or bytes([byte]))[0] < 0xF0 else 4
                    if len(read) + 1 == n:
                        found.append((read + bytes([byte])).decode())
                    else:
                        open_.append((next_[0], read + bytes([byte])))
        return found

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes] | None:
        """The end of the longest known run of bytes from at, and what replaces it."""
        state, best = self.root(), None
        for i in range(at, len(raw)):
            if (next_ := self.step(state, raw[i])) is None:
                break
            state, ends = next_
            if ends:
                best = i + 1, self.written(state)
        return best

    def __call__(self, text: str) -> str:
        """text with every known run replaced, left to right, the longest first; what begins none is passed over at once."""
        if self.first is None:
            return text
        out, at = [], 0
        while (m := self.first.search(text, at)) is not None:
            start = m.start()
            raw = text[start : start + MAP_CHARS].encode("utf-8", "surrogatepass")
            out.append(text[at:start])
            found = self.longest(raw, 0)
            if found is None:
                out.append(text[start])
                at = start + 1
            else:
                out.append(found[1].decode("utf-8", "replace"))
                at = start + len(raw[: found[0]].decode("utf-8", "ignore"))
        return "".join([*out, text[at:]])


class Normaliser:
    """The character map, then blanks: extra ones go (one_blank), one is put in front (dummy_prefix)."""

    def __init__(self, dummy_prefix: bool, one_blank: bool, escape: bool, charsmap: bytes):
        self.map = CharMap(charsmap) if len(charsmap) > 4 else None
        self.dummy_prefix, self.one_blank, self.space = dummy_prefix, one_blank, META if escape else " "

    def __call__(self, text: str) -> str:
        """The normalised text; its spaces stand for the meta symbol, which chunks get when they are first seen.

        The table of blanks has two states, begun and within blanks: a run of
        them writes one before text, and none at either end.
        """
        if not text:
            return ""
        if self.map:
            text = self.map(text)
        if self.one_blank and not (text := BLANK_RUNS.sub(" ", text.strip(" "))):
            return ""
        return " " + text if self.dummy_prefix else text

    def undo(self, text: bytes) -> bytes:
        return text[1:] if self.dummy_prefix and text[:1] == b" " else text


class Memo:
    """What was looked up last, in two generations: at least the last `size` keys, at most twice as many."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def get(self, key: str) -> bytes | None:
        got = self.young.get(key)
        if got is None and (got := self.old.get(key)) is not None:
            self.put(key, got)
        return got

    def put(self, key: str, value: bytes) -> None:
        if len(key) <= MEMO_CHARS:
            if len(self.young) >= self.size:
                self.young, self.old = {}, self.young
            self.young[key] = value


class Machine:
    """A compiled model."""

    def __init__(self, pieces: list[tuple[str, float, int]], model_type: int, normaliser: Normaliser):
        self.normaliser, self.model_type = normaliser, model_type
        self.score = [s for _, s, _ in pieces]
        self.ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER)}
        self.unknown = next((i for i, x in enumerate(pieces) if x[2] == UNKNOWN), 0)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        blank = {CONTROL: b"", UNKNOWN: " ⁇ ".encode()}
        self.plain = [bytes([int(p[3:5], 16)]) if kind == BYTE else blank.get(kind, p.replace(META, " ").encode()) for p, _, kind in pieces]
        self.text = [p for p, _, _ in pieces]
        held = set("".join(self.ids))
        # no piece goes on after other characters with the meta symbol, so texts fall apart before it
        apart = all(META not in p.lstrip(META) for p in self.ids) and normaliser.space == META
        self.apart = re.compile((" *[^ \n]+| +|\n" if "\n" not in held else " *[^ ]+| +") if apart else "(?s).+")
        self.least = min((self.score[i] for i in self.ids.values()), default=0.0) - UNKNOWN_PENALTY
        self.beside = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}  # characters that some piece holds side by side
        self.memo = Memo(MEMO_CHUNKS)
        if model_type == BPE:
            order = sorted({-self.score[i] for p, i in self.ids.items() if len(p) > 1})
            rank = {s: n for n, s in enumerate(order)}
            self.rank = {p: rank[-self.score[i]] if len(p) > 1 else -1 for p, i in self.ids.items()}
            shared: dict[int, int] = {}
            for p in self.ids:
                shared[self.rank[p]] = shared.get(self.rank[p], 0) + 1
            self.tied = {p for p in self.ids if len(p) > 1 and shared[self.rank[p]] > 1}
            self.parts: dict[str, tuple[str, str] | None] = {}
            self.pairs: dict[int, bool] = {}
            for p in [p for p in self.ids if len(p) > 1 and self.split(p) is None]:  # merging never makes these
                del self.ids[p]
        self.arcs: list[dict[str, int]] = [{}]  # transitions of the pieces' trie, by state
        self.writes: list[int] = [-1]  # the piece id of a final state
        for p, i in self.ids.items():
            state = 0
            for c in p:
                after = self.arcs[state].get(c)
                if after is None:
                    after = self.arcs[state][c] = len(self.arcs)
                    self.arcs.append({})
                    self.writes.append(-1)
                state = after
            self.writes[state] = i

    @classmethod
    def compile(cls, model: bytes) -> Machine:
        pieces, trainer, normal = [], {}, {}
        for number, value in fields(model):
            if number == 1:
                f = dict(fields(value))
                pieces.append((f.get(1, b"").decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normal = dict(fields(value))
        kind = trainer.get(3, UNIGRAM)
        if kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        return cls(pieces, kind, Normaliser(bool(normal.get(3, 1)), bool(normal.get(4, 1)), bool(normal.get(5, 1)), normal.get(2, b"")))

    def merged(self, text: str) -> tuple[list[str], list[tuple[str, str]]]:
        """What merging leaves of a short text, and the merges that it made."""
        parts, made = list(text), []
        while True:
            best = min(((self.rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.rank), default=None)
            if best is None:
                return parts, made
            i = best[1]
            made.append((parts[i], parts[i + 1]))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def split(self, piece: str) -> tuple[str, str] | None:
        """The two parts whose merge makes piece; None for a character, or where merging never makes it."""
        if piece not in self.parts:
            left, made = self.merged(piece) if len(piece) > 1 else ([], [])
            self.parts[piece] = made[-1] if left == [piece] else None
        return self.parts[piece]

    def pass_together(self, before: int, piece: int) -> bool:
        """Whether merging leaves two pieces next to each other."""
        key = before << 20 | piece
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= MEMO_PAIRS:
                self.pairs.clear()
            a, b = self.text[before], self.text[piece]
            known = self.pairs[key] = self.merged(a + b)[0] == [a, b] if a in self.tied or b in self.tied else self._no_merge_between(a, b)
        return known

    def _no_merge_between(self, a: str, b: str) -> bool:
        rank, limit = self.rank, INF
        while True:
            joined = rank.get(a + b)
            if joined is not None and joined < limit:
                return False
            # go back before the later of the two merges; of equal ones the left was first
            if rank[a] > rank[b]:
                limit, a = rank[a], self.split(a)[1]
            elif rank[b] < 0:
                return True
            else:
                limit, b = rank[b] + 1, self.split(b)[0]

    def fall_back(self, char: str) -> list[int]:
        """The arcs of a character that is no piece: its bytes, or the unknown piece."""
        raw = char.encode("utf-8", "surrogatepass")
        return [self.bytes[b] for b in raw] if all(b in self.bytes for b in raw) else [self.unknown]

    def shortest_path(self, chunk: str) -> list[int]:
        """Piece ids of the path of least weight through the composition of a normalised text with the machine.

        Arcs go forward in the text, so positions are relaxed in order. One
        state is kept for each: of a BPE model only one piece ends there with a
        finite weight, as the text before has one encoding.
        """
        arcs, writes, score, bpe, n = self.arcs, self.writes, self.score, self.model_type == BPE, len(chunk)
        weight, last, before = [0.0] + [INF] * n, [-1] * (n + 1), [0] * (n + 1)  # last: the piece that was written (-1: bytes)
        fallback = 0.0 if bpe else -self.least
        for start in range(n):
            here = weight[start]
            if here == INF:
                continue
            prev, end, state = last[start], start, arcs[0].get(chunk[start])
            if (state is None or writes[state] < 0) and here + fallback < weight[start + 1]:
                weight[start + 1], last[start + 1], before[start + 1] = here + fallback, -1, start
            while state is not None:
                end += 1
                piece = writes[state]
                if piece >= 0 and here - (0.0 if bpe else score[piece]) < weight[end] and (not bpe or prev < 0 or self.pass_together(prev, piece)):
                    weight[end], last[end], before[end] = here - (0.0 if bpe else score[piece]), piece, start
                state = arcs[state].get(chunk[end]) if end < n else None
        path, end = [], n
        while end:
            path.append((before[end], last[end]))
            end = before[end]
        out: list[int] = []
        for start, piece in reversed(path):
            got = [piece] if piece >= 0 else self.fall_back(chunk[start])
            if got != [self.unknown] or out[-1:] != got:  # unknown characters in a row are one
                out += got
        return out

    def encode_part(self, raw: str) -> bytes:
        got = self.memo.get(raw)
        if got is None:
            got = np.array(self.shortest_path(raw.replace(" ", self.normaliser.space)), dtype=np.int32).tobytes()
            self.memo.put(raw, got)
        return got

    def encode_chunk(self, raw: str) -> bytes:
        """Every path goes through the places between characters that no piece holds side by side, so the parts between them are encoded alone."""
        chunk, beside = raw.replace(" ", self.normaliser.space), self.beside
        cuts = [i for i in range(1, len(chunk)) if chunk[i - 1 : i + 1] not in beside]
        if not cuts or not self.bytes:  # without byte fallback unknown characters in a row become one piece
            return self.encode_part(raw)
        got = self.memo.get(raw)
        if got is None:
            got = b"".join([self.encode_part(raw[a:b]) for a, b in zip([0, *cuts], [*cuts, len(raw)])])
            self.memo.put(raw, got)
        return got

    def encode(self, text: str) -> np.ndarray:
        known, new = self.memo.young.get, self.encode_chunk
        found = []
        for chunk in self.apart.findall(self.normaliser(text)):
            got = known(chunk)
            if got is None:
                got = new(chunk)
                known = self.memo.young.get
            found.append(got)
        return np.frombuffer(b"".join(found), dtype=np.int32)

    def decode(self, ids) -> str:
        return self.normaliser.undo(b"".join(map(self.plain.__getitem__, ids.tolist()))).decode("utf-8", "replace")


def load(path: str) -> Machine:
    """Compile a model file; path is read on the driver."""
    with open(path, "rb") as f:
        return Machine.compile(f.read())


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def coded(docs: DataFrame, machine: Machine, encoding: bool = True, decoding: bool = True, text_col: str = "text", ids_col: str = "piece_ids", out_col: str = "decoded") -> DataFrame:
    """docs with ids_col array<int> (encoding; replaced if there) and out_col (decoding), the text that the ids give back.

    Whole texts are encoded: null gives null, an empty text no ids. The decoded
    text equals the text but for META, which comes back as a space. Equal texts
    get equal ids; extra columns pass through; an empty table gives no rows.
    The machine (its size is the model's) is sent to each task.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    keep = [c for c in docs.columns if not (encoding and c == ids_col) and not (decoding and c == out_col)]
    if not encoding:
        keep = [c for c in keep if c != ids_col] + [ids_col]
    schema = T.StructType([docs.schema[c] for c in keep])
    schema = schema.add(ids_col, T.ArrayType(T.IntegerType())) if encoding else schema
    schema = schema.add(out_col, T.StringType()) if decoding else schema

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Machine = shared.value
        for whole in batches:
            for lo in range(0, whole.num_rows, BATCH_ROWS):
                b = whole.slice(lo, BATCH_ROWS)
                columns = [b.column(b.schema.get_field_index(c)) for c in keep]
                if encoding:
                    ids = [None if t is None else m.encode(t) for t in b.column(b.schema.get_field_index(text_col)).to_pylist()]
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                else:
                    ids = [None if x is None else np.array(x, dtype=np.int32) for x in columns[-1].to_pylist()]
                if decoding:
                    columns.append(pa.array([None if x is None else m.decode(x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(code, schema)


def encode(docs: DataFrame, machine: Machine, **cols: str) -> DataFrame:
    return coded(docs, machine, decoding=False, **cols)


def decode(docs: DataFrame, machine: Machine, **cols: str) -> DataFrame:
    return coded(docs, machine, encoding=False, **cols)


def query(docs: DataFrame, model: str | None = None) -> DataFrame:
    machine = load(model or default_model())
    both = coded(docs.select("doc_id", "text"), machine)
    return both.select(
        "doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), F.xxhash64("piece_ids").alias("pieces_hash"),
        F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == F.replace("text", F.lit(META), F.lit(" "))).alias("round_trip"),
    )


def tokenized(docs: DataFrame, model: str | None = None) -> DataFrame:
    """docs with their piece ids, and the text read back from them."""
    machine = load(model or default_model())
    docs = docs.drop("piece_ids", "n_pieces")
    return shielded(docs, ["text"], lambda d: coded(d, machine).withColumn("text", F.col("decoded")).drop("decoded").withColumn("n_pieces", F.size("piece_ids")))
