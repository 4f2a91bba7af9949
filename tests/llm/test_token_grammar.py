"""Grammars of token files: rounds look only at places that can still change, reading expands by array."""

import numpy as np

from brinelake.llm import tokenfile
from brinelake.llm.queries import tokenizer_file


def test_rare_pairs_are_not_sorted_again(monkeypatch):
    rng = np.random.default_rng(5)
    ids = np.concatenate([rng.integers(0, 40_000, 30_000), np.tile(rng.integers(0, 40_000, 50), 40)]).astype("<u4")
    sizes, sort = [], np.sort
    monkeypatch.setattr(np, "sort", lambda x, *a, **k: sizes.append(len(x)) or sort(x, *a, **k))
    rules, seq = tokenfile.repair(ids, 40_000)
    monkeypatch.undo()
    assert len(rules) > 40 and sizes[0] == len(ids) - 1 and max(sizes[1:]) < len(ids) // 4
    shard = tokenfile.Shard(40_000, rules.tobytes(), seq.tobytes(), tokenfile.rule_lengths(rules, 40_000).tobytes())
    assert np.array_equal(shard.read(), ids)


def _grammar(ids, top, least):
    """The same rounds, every pair counted anew in each."""
    seq, rules = ids.tolist(), []
    while True:
        pairs = list(zip(seq, seq[1:]))
        count = {p: pairs.count(p) for p in set(pairs)}
        most = max(count.values(), default=0)
        if most < least:
            return rules, seq
        chosen = sorted(p for p in count if count[p] >= max(least, most // 64))
        slots, first = tokenfile._slot(np.array([a << 32 | b for a, b in chosen], np.int64)).tolist(), {}
        for s, p in zip(slots, chosen):
            first.setdefault(s, p)
        chosen, out, marks, k = [first[s] for s in sorted(first)], [], [], 0
        while k < len(seq):
            if tuple(seq[k:k + 2]) in chosen:
                marks.append((len(out), tuple(seq[k:k + 2])))
                out.append(None)
                k += 2
            else:
                out.append(seq[k])
                k += 1
        used = [p for p in chosen if any(p == q for _, q in marks)]
        for at, p in marks:
            out[at] = top + used.index(p)
        rules += used
        top, seq = top + len(used), out


def test_grammar_is_that_of_full_counts():
    rng = np.random.default_rng(6)
    for n, k, least in [(0, 1, 2), (1, 1, 2), (2, 1, 2), (60, 1, 2), (200, 2, 2), (300, 4, 3), (300, 3, 8), (120, 90, 2)]:
        ids = rng.integers(0, k, n).astype("<u4")
        rules, seq = tokenfile.repair(ids, 100, least)
        expected = _grammar(ids, 100, least)
        assert [tuple(r) for r in rules.tolist()] == expected[0] and seq.tolist() == expected[1]
        shard = tokenfile.Shard(100, rules.tobytes(), seq.tobytes(), tokenfile.rule_lengths(rules, 100).tobytes())
        for i in range(0, n, 7):
            assert np.array_equal(shard.read(i, i + 20), ids[i:i + 20])


def test_words_met_first_late_and_after_the_memory_is_cleared(monkeypatch):
    coder = tokenfile.WordIds(tokenizer_file("word_bpe_49k.json"))
    texts = ["", " ", "The ocean,  the ocean\n\nbreathes", "it's 12 a-b", "tab\tand more", "x" * 70 + " Ünïted ÉTÉ... a.b",
             "<|endoftext|> <|ENDOFTEXT|> here", "e ́combining", None, "İstanbul ΟΔΟΣ ﬁn", "it's 12 again, it's"]
    whole = [np.array(coder.library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    for cache in (tokenfile.CACHE, 3):
        monkeypatch.setattr(tokenfile, "CACHE", cache)
        monkeypatch.setattr(tokenfile, "PIECES", cache)
        assert coder.encode_batch(texts) == whole and coder.encode_batch(texts[::-1]) == whole[::-1]
        assert [coder.encode_batch([t])[0] for t in texts] == whole
