import random
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from communa.llm import chat

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def talks(spark):
    return spark.read.parquet(f"{SF}/conversations.parquet").cache()


@pytest.fixture(scope="module")
def model(talks):
    return chat.fit(talks, F.col("conv_id") % 3 != 0)


def test_decode_is_the_best_path(model):
    rng = random.Random(3)
    pool = ["User: hi", "Assistant: yes", "", "text", "System: x", "What?", "Q: a?", "Note: b", "t" * 90]
    for _ in range(25):
        lines = [rng.choice(pool) for _ in range(rng.randrange(1, 6))]
        codes = chat.symbols(lines)

        def score(path, codes=codes):
            return model.first[path[0]] + sum(model.after[a, b] for a, b in zip(path, path[1:], strict=False)) + sum(model.shown[s, c] for s, c in zip(path, codes, strict=True))

        got = model.decode(lines)
        assert np.isclose(score(got), max(score(p) for p in product(range(chat.STATES), repeat=len(lines))))


def test_roles_of_held_out_conversations(talks, model):
    got = chat.format_conversations(chat.as_transcripts(talks.filter("conv_id % 3 = 0")), model).agg(F.sum("n_right"), F.sum("n_lines")).first()
    assert got[0] / got[1] > 0.95


def test_chunks_join_to_the_whole(talks, model):
    turns = chat.as_transcripts(talks)
    whole = {r.conv_id: r for r in chat.format_conversations(turns, model).collect()}
    parts = {}
    for r in chat.format_conversations(turns, model, 1).orderBy("conv_id", "chunk").collect():
        parts.setdefault(r.conv_id, []).append(r)
    assert len(whole) == talks.select("conv_id").distinct().count() and max(map(len, parts.values())) > 5
    for conv, rows in parts.items():
        assert sum(r.n_turns for r in rows) == whole[conv].n_turns
        assert ",".join(r.roles for r in rows if r.roles) == whole[conv].roles
        assert sum(r.n_right for r in rows) == whole[conv].n_right
        joined, one = ("".join(r.rendered for r in rows), whole[conv].rendered)
        assert [x for x in joined.split("\n") if x.strip()] == [x for x in one.split("\n") if x.strip()]


def test_parse_texts(odd_docs, no_docs, model):
    got = chat.parse(odd_docs, model).collect()
    assert len(got) == odd_docs.count() and all((r.rendered is None) == (not r.turns) for r in got)
    assert chat.parse(no_docs, model).collect() == []
    text = "User: How are you?\n\nAssistant: Fine.\nThanks.\n\nUser: Good."
    one = chat.parse(odd_docs.sparkSession.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert [(t.role, t.text) for t in one.turns] == [("user", "How are you?"), ("assistant", "Fine.\nThanks."), ("user", "Good.")]
    assert one.rendered == "<|user|>\nHow are you?\n<|end|>\n<|assistant|>\nFine.\nThanks.\n<|end|>\n<|user|>\nGood.\n<|end|>\n"


def test_odd_conversations(spark, model):
    data = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 1, "assistant", None), (2, None, None, ""), (None, 0, "user", "x"), (3, 0, "tool", "t"), (3, 5000, "user", "late"), (4, 0, "user", "a\nb " * 20000), (5, -1, "system", "s")]
    df = spark.createDataFrame([(*r, 1, "y") for r in data], "conv_id long, turn long, role string, text string, chunk int, lines string")
    got = chat.format_conversations(chat.as_transcripts(df), model).collect()
    assert sorted({r.conv_id for r in got}) == [1, 2, 3, 4, 5] and len([r for r in got if r.conv_id == 3]) == 2
    assert chat.format_conversations(chat.as_transcripts(df.limit(0)), model).collect() == []
    assert chat.fit(df.limit(0)).decode(["x"]) is not None


@pytest.mark.parametrize("turn", [None, 7])
def test_crowded_turns_go_in_parts(spark, model, turn):
    """All turns of a conversation null, or of one number: parts and bundles of a few, with the result of one pass."""
    rng = random.Random(8)
    data = [(c, turn, rng.choice(["user", "assistant"]), f"line {rng.randrange(1000)}\nand {i}?") for c in (1, 2) for i in range(60)]
    turns = chat.as_transcripts(spark.createDataFrame(data, "conv_id long, turn long, role string, text string"))
    whole = {r.conv_id: r for r in chat.format_conversations(turns, model).collect()}
    parts = {}
    for r in chat.format_conversations(turns, model, 2, 3).orderBy("conv_id", "chunk", "part").collect():
        parts.setdefault(r.conv_id, []).append(r)
    assert set(whole) == set(parts) == {1, 2} and all(len(x) == 30 for x in parts.values())
    for conv, rows in parts.items():
        assert [sum(r[c] for r in rows) for c in ("n_lines", "n_turns", "n_right")] == [whole[conv][c] for c in ("n_lines", "n_turns", "n_right")]
        assert ",".join(r.roles for r in rows if r.roles) == whole[conv].roles
        joined, one = ("".join(r.rendered for r in rows), whole[conv].rendered)
        assert [x for x in joined.split("\n") if x.strip()] == [x for x in one.split("\n") if x.strip()]
