"""What a chat task holds does not grow with the rows that it gets at once."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from brinelake.llm import chat
from brinelake.llm.common import tokenizer_file

FILE = tokenizer_file("byte_bpe_50k.json")
R = random.Random(17)
WORDS = ["the", "Überzug", "of", "don't", "x1", "日本語", "😀", "é", "\x1c", "a b", "12345", "</turn>", "\\", "<|endoftext|>"]


def some_text(n):
    return "".join([R.choice(WORDS) + R.choice([" ", " ", " ", "\n", "  ", "\n\n", "\t", " ", ""]) for _ in range(n)])


def most_held(run, batch):
    """Batches that a function makes of one, and the most MB of Python's memory that it held."""
    list(run(iter([batch.slice(0, 1)])))
    out, most = [], 0
    tracemalloc.start()
    try:
        for made in run(iter([batch])):
            out.append(made)
            most = max(most, tracemalloc.get_traced_memory()[1])
        most = max(most, tracemalloc.get_traced_memory()[1])
    finally:
        tracemalloc.stop()
    return out, most / 1e6


def test_many_conversations_in_one_batch(spark, monkeypatch):
    tasks = []
    df = spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    real = type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, fn, *a: tasks.append(fn) or real(self, fn, *a))
    chat.read_back(chat.formatted(df, FILE))
    turns = [[{"turn": k, "role": ("user", "assistant")[k % 2], "text": some_text(250)} for k in range(4)] for _ in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(turns)], names=["conv_id", "turns"])
    chats, most = most_held(tasks[0], batch)
    assert sum(b.num_rows for b in chats) == 300 and most < 20
    whole = pa.Table.from_batches(chats).combine_chunks().to_batches()[0].drop_columns(["ids"])
    rows, most = most_held(tasks[1], whole)
    assert most < 20
    back = pa.Table.from_batches(rows).to_pylist()
    assert [r["conv_id"] for r in back] == list(range(300)) and all(r["n_turns"] == 4 for r in back)
    assert [r["loss_chars"] for r in back] == [sum(len(t["text"]) for t in x if t["role"] == "assistant") for x in turns]


@pytest.mark.parametrize("chars", [1, 40, 1000])
def test_parts_have_the_tokens_of_the_whole(chars, monkeypatch):
    library = chat._library(FILE)
    for text in ["", "a", " \n ", "x" * 3000, *(some_text(300) for _ in range(40))]:
        cut = list(chat.parts(text, chars))
        assert "".join([p for _, p in cut]) == text and all(text.startswith(p, at) for at, p in cut)
        assert len(cut) > 3 or chars == 1000 or len(text) < 3001
        monkeypatch.setattr(chat, "parts", lambda _, cut=cut: cut)
        ids, spans = chat.encoded(text, FILE)
        monkeypatch.undo()
        one = library.encode(text, add_special_tokens=False)
        assert ids.tolist() == one.ids and spans.tolist() == [list(x) for x in one.offsets]


def test_an_edge_inside_a_token():
    text, spans = "<turn>assistant\nab</turn>\n", np.array([[0, 17], [17, 20], [20, 26]])
    under = chat.mask(spans, np.array([16]), np.array([18]))
    assert under.tolist() == [True, True, False] and chat.trained_text(text, spans, under, [16], [18]) == "ab"
