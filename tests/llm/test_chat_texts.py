"""Chat examples with very long texts, and with columns named like those that the operator makes."""

import hashlib

from thriftline.llm import chat

NAMES = "formatted string, loss_start string, loss_length string, n_turns string, roles string, turns string, whole string, last string"


def test_long_texts_and_clashing_names(spark):
    long = "<s>[~ " + "lorem ipsum ]" * 40_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long), (1, 2, "assistant", ""), (2, 0, "assistant", "</s>" * 30_000)]
    conv = spark.createDataFrame([(*r, *["x"] * 8) for r in rows], f"conv_id long, turn long, role string, text string, {NAMES}")
    made = chat.expand_targets(conv)
    assert made.count() == 3 and made.columns == ["conv_id", "target", "n_turns", "formatted", "loss_start", "loss_length"]
    got = {r.conv_id: r for r in chat.digest(made).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (got[1].n_turns, got[1].loss_chars, got[1].loss_sha256) == (3, len(long), sha(long))
    assert got[1].turns_sha256 == sha(f"user\n{long}\nassistant\n{long}\nassistant\n\n") and got[2].loss_sha256 == sha("</s>" * 30_000)
