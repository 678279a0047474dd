from __future__ import annotations

import hashlib
import random

import pytest

from periodica.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, piece string, loss_start long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 5) for r in rows], SCHEMA)


def test_every_turn_reads_back(spark):
    rng = random.Random(3)
    parts = ["<", "|", "\\", "<|", "<|im_end|>", "<|im_start|>", "é", "😀", "\n", "a", ""]
    rows = [
        (
            i,
            0,
            rng.choice(["user", "assistant", "a\nb\\n", "<|x", None]),
            "".join(rng.choice(parts) for _ in range(rng.randint(0, 9))),
        )
        for i in range(400)
    ]
    rows += [(1000, 0, "assistant", "x" * 3_000_000 + "<|"), (1001, 0, "assistant", None)]
    found = {r["conv_id"]: r for r in chat.format_turns(frame(spark, rows)).collect()}
    for conv, _, role, text in rows:
        r = found[conv]
        role, text = role or "", text or ""
        assert chat.parse(r["piece"]) == (role, text)
        assert r["piece"].count("<|im_start|>") == r["piece"].count("<|im_end|>") == 1
        if role == "assistant":
            assert chat._plain(r["piece"][r["loss_start"] : r["loss_end"]]) == text
        else:
            assert r["loss_start"] is None


def test_digests(spark):
    rows = [(1, 1, "assistant", "zwei"), (1, 0, "user", "eins"), (1, 2, "assistant", "dréi")]
    rows += [(2, 0, "user", None), (None, None, "assistant", "x"), (None, 3, "assistant", "y")]
    rows += [(7, i, "assistant", f"turn {i}") for i in range(3000)]  # most rows in one conversation
    rows += [(8, 0, "user", "same")] * 2
    found = {r["conv_id"]: r for r in chat.digests(chat.format_turns(frame(spark, rows))).collect()}
    assert set(found) == {1, 2, 7, 8, None}
    one = found[1]
    told = "user\neins\nassistant\nzwei\nassistant\ndréi\n"
    assert one["turns_sha256"] == hashlib.sha256(told.encode()).hexdigest()
    assert one["loss_sha256"] == hashlib.sha256("zweidréi".encode()).hexdigest()
    assert (one["n_turns"], one["loss_chars"]) == (3, 8)
    pieces = [chat.START, chat.AFTER_ROLE, chat.END]
    assert one["formatted_chars"] == 3 * len(b"".join(pieces)) + 4 + 9 + 9 + 12
    hot = "".join(f"turn {i}" for i in range(3000))
    assert found[7]["loss_sha256"] == hashlib.sha256(hot.encode()).hexdigest()
    assert found[None]["loss_sha256"] == hashlib.sha256(b"xy").hexdigest()
    assert (found[8]["n_turns"], found[2]["loss_chars"]) == (2, 0)


def test_what_is_no_turn_is_refused():
    with pytest.raises(ValueError, match="formatted"):
        chat.parse("user\nhello")


def test_empty_tables(spark):
    assert chat.digests(chat.format_turns(frame(spark, []))).collect() == []
