"""Models written by hand, with a character map, of both types, against an independent implementation. Nothing is trained."""

import random
import struct

import pytest
import sentencepiece

from thriftline.llm import sentencepiece_fst as fst

LETTERS = "abcdé"
MAP = {"ﬁ": "fi", "　": " ", "Á": "a", "AB": "ab", "A": "a", "①": "1", "​": "", "Ａ": "a", "ab①": "d"}


def varint(n: int) -> bytes:
    out = b""
    while True:
        n, b = n >> 7, n & 0x7F
        out += bytes([b | (0x80 if n else 0)])
        if not n:
            return out


def field(number: int, value: bytes | float | int) -> bytes:
    if isinstance(value, bytes):
        return varint(number << 3 | 2) + varint(len(value)) + value
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3) + varint(value)


def double_array(table: dict[str, str]) -> bytes:
    """A character map as a model file holds it: each state has a block of units, and a unit leads to the next state's block."""
    keys = {k.encode(): v.encode() for k, v in table.items()}
    texts, at = b"", {}
    for k, v in keys.items():
        at[k] = len(texts)
        texts += v + b"\0"
    states = sorted({k[:i] for k in keys for i in range(len(k) + 1)})
    base = {s: 256 * (n + 1) for n, s in enumerate(states)}
    units = [0] * (256 * (len(states) + 1))
    units[0] = base[b""] << 10
    for s in states:
        if s:
            place = base[s[:-1]] ^ s[-1]
            units[place] = (place ^ base[s]) << 10 | s[-1] | (0x100 if s in keys else 0)
        if s in keys:
            units[base[s]] = at[s] | 1 << 31
    blob = struct.pack(f"<{len(units)}I", *units)
    return struct.pack("<I", len(blob)) + blob + texts


def model(pieces: list[tuple[str, float]], kind: int, charsmap: bytes, extra: bool, prefix: bool, byte_pieces: bool) -> bytes:
    special = [("<unk>", 0.0, fst.UNKNOWN), ("<s>", 0.0, fst.CONTROL), ("</s>", 0.0, fst.CONTROL)]
    rows = special + [(f"<0x{i:02X}>", 0.0, fst.BYTE) for i in range(256 * byte_pieces)] + [(p, s, fst.NORMAL) for p, s in pieces]
    out = b"".join(field(1, field(1, p.encode()) + field(2, float(s)) + field(3, k)) for p, s, k in rows)
    out += field(2, field(3, kind) + (field(35, 1) if byte_pieces else b"") + field(40, 0) + field(41, 1) + field(42, 2))
    return out + field(3, field(1, b"own") + (field(2, charsmap) if charsmap else b"") + field(3, int(prefix)) + field(4, int(extra)) + field(5, 1))


def unigrams(rng):
    pieces = [("▁", -3.0)] + [(c, -4.0 - i * 0.37) for i, c in enumerate(LETTERS)]
    while len(pieces) < 60:
        p = ("▁" if rng.random() < 0.3 else "") + "".join(rng.choices(LETTERS, k=rng.randrange(1, 5)))
        if p not in dict(pieces):
            pieces.append((p, -round(rng.uniform(2, 12), 3)))
    return pieces


def merges(rng):
    pieces = [("▁", -100.0)] + [(c, -101.0 - i) for i, c in enumerate(LETTERS)]
    while len(pieces) < 46:
        a, b = rng.choice(pieces)[0], rng.choice(pieces)[0]
        if a + b not in dict(pieces) and "▁" not in b and len(a + b) < 6:
            pieces.append((a + b, -float(len(pieces))))
    return pieces


@pytest.mark.parametrize("kind", [fst.UNIGRAM, fst.BPE])
@pytest.mark.parametrize("byte_pieces", [False, True])
@pytest.mark.parametrize("charsmap", [b"", double_array(MAP)])
@pytest.mark.parametrize("extra", [False, True])
@pytest.mark.parametrize("prefix", [False, True])
def test_least_paths_are_those_of_an_independent_implementation(kind, byte_pieces, charsmap, extra, prefix):
    rng = random.Random(3)
    data = model(unigrams(rng) if kind == fst.UNIGRAM else merges(rng), kind, charsmap, extra, prefix, byte_pieces)
    other, machine = sentencepiece.SentencePieceProcessor(model_proto=data), fst.Machine.compile(data)
    texts = ["", "a", " ", "abc dé", "  ab  cd ", "ﬁab　Á AB A① ​ab", "xyz ab", "ＡＡ ab① ab①c", "​", "​ ​", "日本 ab", "a\nb\tc", "▁a▁ b", "a" * 3000]
    texts += ["".join(rng.choices(LETTERS + "  xﬁＡ　①Áé​", k=rng.randrange(60))) for _ in range(400)]
    for t in texts:
        assert machine.encode(t).tolist() == other.encode(t), t


def test_the_machine_is_made_of_transitions():
    machine = fst.load(fst.default_model())
    for piece in ("▁the", "ing", "é"):
        state = 0
        for c in piece:
            state = machine.arcs[state][c]
        assert machine.text[machine.writes[state]] == piece
    assert len(machine.arcs) == len(machine.writes) > len(machine.ids)
    assert machine.shortest_path("🤗") == [machine.bytes[b] for b in "🤗".encode()]


def test_runs_of_a_character_map():
    known = fst.CharMap(double_array(MAP))
    assert known("ﬁ A AB ab① ab ①​x") == "fi a ab d ab 1x" and known("") == "" and known("日本") == "日本"
    assert fst.CharMap(double_array({"a": "b"})).first.findall("banana") == ["a", "a", "a"]
