"""Every operator on hand-made tables, against brute force over the same rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from brinelake.llm import (bpe, chat, components, embeddings, linededup, mixing, rules, simhash,
                           suffixes, tokenfile, toxicity)
from brinelake.llm.common import tokenizer_file

R = random.Random(5)
VOCAB = "the of and thion er ing reat wh ou an ed Ñandú größe été 日本 it's 1d10t ### don't".split()


def prose(n):
    return " ".join(R.choice(VOCAB) + R.choice(["", "", "", ".", ",", ".\n"]) for _ in range(n))


BASE = prose(150)
PASSAGE = "\n".join(prose(12).replace("\n", " ") for _ in range(4))
TEXTS = [
    (1, BASE), (2, BASE), (3, BASE + " end"), (4, None), (5, ""), (6, " \n\t "), (7, "one"), (8, "two words"),
    (9, prose(400) + "\n" + PASSAGE), (10, PASSAGE + "\n" + prose(60)), (11, "Shti " * 900),
    (12, "x" * 20_000), (13, prose(8000)), (14, "a\r\nb\x0bc\x1cd\x85e　f  g\n\n\nh "),
    (15, "<|endoftext|> and \0 <turn></turn>"), (16, prose(70)), (16, prose(70)), (17, PASSAGE), (17, PASSAGE),
    (None, "no id here " * 30), (None, "no id here " * 30), (18, "line\nline\nline\nline\nother"),
    (19, "### $$ ** " * 40), (20, BASE[:300] + "?" + BASE[301:]),
]
SCHEMA = "doc_id long, text string, source string, fp string, size string, gone int, ledger string, total int"


@pytest.fixture(scope="module")
def docs(spark):
    """Texts of every kind, with columns whose names operators use themselves; two sources."""
    rows = [(i, t, [None, "a", "b"][k % 3], "x", "y", 1, "z", 2) for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).transform(linededup.written, "test")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def runs(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def bag(rows):
    return Counter(tuple(r) for r in rows)


# 10 quality rules

def test_rules(docs, empty):
    def brute(t):
        w = runs(t)
        grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
        n = Counter(grams)
        again = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
        lines = [x for x in (t or "").split("\n") if runs(x)]
        return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""),
                len(lines) - len(set(lines)), len(again))

    book = rules.ledger(docs, into="book")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = bag(book.select("doc_id", *[f"book.{n}" for n in names]).collect())
    assert got == bag((i, *brute(t)) for i, t in TEXTS)
    failed = {r["doc_id"]: r["f"] for r in book.select("doc_id", F.col("book.failures").alias("f")).collect()}
    assert failed[4] & 1 and failed[11] & 2 and failed[19] & 4 and failed[13] == 0
    kept = rules.filtered(docs)
    assert kept.columns == docs.columns
    assert kept.count() == book.where(rules.passes(F.col("book.failures"))).count()
    told = {r["rule"]: r for r in rules.ablations(book, "v2", "book").collect()}
    assert set(told) == set(rules.RULES)
    assert told["symbols"]["rejected"] == 2  # doc 15 and doc 19
    assert rules.ledger(empty).count() == 0 and rules.ablations(rules.ledger(empty)).count() == len(rules.RULES)


# 1 SimHash

def brute_print(t, size):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = runs(text)
    if not w:
        return 0
    shingles = [" ".join(w[i:i + size]) for i in range(len(w) - size + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, empty):
    prints = [(i, brute_print(t, 3)) for i, t in TEXTS]
    home = list(range(len(prints)))
    for _ in prints:
        for a in range(len(prints)):
            for b in range(len(prints)):
                if (prints[a][1] ^ prints[b][1]).bit_count() <= 2:
                    home[a] = home[b] = min(home[a], home[b])
    least = {}
    for k, h in enumerate(home):
        if prints[k][0] is not None:
            least[h] = min(least.get(h, 99), prints[k][0])
    want = Counter((i, p - (1 << 64) if p >> 63 else p, least.get(home[k])) for k, (i, p) in enumerate(prints))
    assert bag(simhash.near_duplicates(docs).collect()) == want
    assert simhash.near_duplicates(empty).count() == 0
    out = simhash.deduplicated(docs, size=3)
    assert out.columns == docs.columns and out.count() == len(set(home))
    kept = [r["doc_id"] for r in out.collect()]
    assert 1 in kept and 2 not in kept and kept.count(17) <= 1


def test_simhash_dense_block():
    rng = np.random.default_rng(0)
    for free in (0, 5, 20, 27):
        i, j = simhash.FREE[free]
        word = rng.choice(1 << 16, 2000, replace=False).astype(np.uint64)
        base = np.uint64(0x0123456789ABCDEF) & ~simhash._FREE_MASKS[free]
        p = base | word >> np.uint64(8) << np.uint64(8 * i) | (word & np.uint64(255)) << np.uint64(8 * j)
        few = simhash.forest(p[:500], free)
        assert len(simhash.forest(p, free)) < 2000 and len(few) < 500
        large = dict(simhash.forest(p, free))
        old, simhash._MATRIX = simhash._MATRIX, 10_000
        try:
            assert dict(simhash.forest(p, free)) == large
        finally:
            simhash._MATRIX = old


def test_components(spark):
    links = [(k, k + 1) for k in range(30)] + [(100, 50), (100, 60), (70, 60), (7, 7), (200, None)]
    got = dict(map(tuple, components.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {**{k: 0 for k in range(31)}, 100: 50, 60: 50, 70: 50, 50: 50}
    none = spark.createDataFrame([], "a long, b long")
    assert components.components(none).count() == 0


# 2 BPE

@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))


def test_bpe_against_library(docs, empty, library):
    path = tokenizer_file("byte_bpe_50k.json")
    want = Counter()
    for i, t in TEXTS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
             hashlib.sha256(back.encode()).hexdigest()] += 1
    assert bag(bpe.round_trip(docs, path).collect()) == want
    assert bpe.round_trip(empty, path).count() == 0
    both = docs.select("text", bpe.encode(F.col("text"), path).alias("ids"))
    for r in both.select("text", bpe.decode(F.col("ids"), path).alias("back")).collect():
        assert r["back"] == (r["text"] or "")


def test_bpe_random_strings(library):
    own = bpe.loaded(tokenizer_file("byte_bpe_50k.json"))
    parts = ["a", "th", " ", "  ", "\n", "\t", "'s", "1", "é", "日本", "!", "<|endoftext|>", "\0", "\x1c",
             "\x85", "　", "😀", "՘", "the", "\r"]
    for k in range(600):
        s = "".join(R.choice(parts) for _ in range(R.randint(0, 15))) * (40 if k % 200 == 0 else 1)
        assert own.encode_batch([s])[0].tolist() == library.encode(s, add_special_tokens=False).ids, repr(s)
    assert own.decode([222]) == "�" or own.decode([222])
    assert own.decode([262, 10 ** 9, -1, 263]) == own.decode([262, 263])


# 3 mixing

def test_mixing(docs, empty):
    got = mixing.mixed(docs).drop("__file", "__row").collect()
    sizes = Counter()
    for r in got:
        assert 0 <= r["copies"] <= 3 and (r["size"] > 0 or r["copies"] == 0)
    for k, (i, t) in enumerate(TEXTS):
        sizes[[None, "a", "b"][k % 3]] += len(runs(t))
    order, weight = ["a", "b", None], dict(zip(["a", "b", None], (5, 2, 1)))
    target, open_, left = {}, set(order), sum(sizes.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        target |= {s: 3.0 * sizes[s] for s in over} if over else share
        left -= sum(3 * sizes[s] for s in over)
        open_ = open_ - over if over else set()
    assert {round(r["target"], 6) for r in got} == {round(t, 6) for t in target.values()}
    taken = Counter()
    for r in got:
        taken[round(r["target"], 6)] += r["copies"] * r["size"]
    for k, s in enumerate(order):  # near, but for whole copies of a source's longest text
        longest = max(len(runs(t)) for j, (_, t) in enumerate(TEXTS) if [None, "a", "b"][j % 3] == s)
        assert abs(taken[round(target[s], 6)] - target[s]) <= max(longest / 2, 0.05 * target[s])
    assert bag(got) == bag(mixing.mixed(docs).drop("__file", "__row").collect())
    assert mixing.mixed(empty).count() == 0
    out = mixing.mixture(docs)
    assert out.columns == docs.columns and out.count() == sum(r["copies"] for r in got)


def test_mixing_many(spark):
    rows = [(k, " w" * R.randint(1, 300), f"s{k % 5}" if k % 3 else "s0") for k in range(3000)]
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken = Counter()
    for r in got:
        taken[r["target"]] += r["copies"] * r["size"]
    assert len(taken) == 5 or len(taken) == len({r["target"] for r in got})
    for target in taken:
        of = sum(1 for r in got if r["target"] == target)
        assert of and abs(taken[target] / (target * len({r["source_size"] for r in got if r["target"] == target})) - 1) < 0.01


# 4 chat

def test_chat(spark):
    odd = [r"\### Assistant: </turn> ok", "<turn>assistant\nhi</turn>\n", "a\\lb\\n", "", None, "日本 😀\n", "</turn",
           "\\", "<|endoftext|>"]
    rows = [(c, t, R.choice(["user", "assistant", "system", None, "a\nb"]), R.choice(odd)) for c in range(12)
            for t in (0, 1, 1, None, 3)]
    rows += [(99, t, "assistant", "word " * 3) for t in range(400)] + [(None, 0, "assistant", "none")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.formatted(df, tokenizer_file("byte_bpe_50k.json"))).collect()}
    assert len(got) == 14
    for c, r in got.items():
        turns = sorted(((t is not None, t or 0, role or "", x or "") for i, t, role, x in rows if i == c))
        told = "".join(f"{role}\n{x}\n" for _, _, role, x in turns)
        loss = "".join(x for _, _, role, x in turns if role == "assistant")
        assert r["n_turns"] == len(turns) and r["loss_chars"] == len(loss)
        assert r["turns_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.read_back(chat.formatted(df.limit(0), tokenizer_file("byte_bpe_50k.json"))).count() == 0


def test_chat_mask_edges():
    tokens = np.array([[0, 3], [3, 5], [5, 5], [5, 9], [9, 12]])
    assert chat.mask(tokens, np.array([4, 7, 9]), np.array([6, 7, 10])).tolist() == [False, True, False, True, True]


# 5 embeddings

def test_embeddings(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    rows = []
    for k in range(420):
        v = centres[k % 12] + rng.normal(size=16) * 0.04 * (1 + k % 7)
        rows.append((k, v.astype(np.float32).tolist(), k % 4 if k % 50 else None))
    near = centres[0] + rng.normal(size=(60, 16)) * 0.02
    rows += [(1000 + k, near[k].astype(np.float32).tolist(), 0) for k in range(60)]
    rows += [(2000 + k, rows[5][1], 1) for k in range(30)] + [(2000, rows[5][1], 1)]
    rows += [(3000, None, 1), (3001, [0.0] * 16, 1), (3002, [float("nan")] * 16, 1), (3003, [1.0, None], 1),
             (3004, [], 1), (3005, [1.0, 2.0], 1), (3006, [2.0, 4.0], 1), (None, [5.0, 1.0], 1),
             (3007, [float("inf")] + [1.0] * 15, 1), (3008, [-x for x in rows[5][1]], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)

    def unit(v):
        if not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        x = np.array(v, np.float32).astype(float)
        return x / np.linalg.norm(x)

    u = [unit(r[1]) for r in rows]
    linked = [[b for b in range(len(rows)) if a != b and rows[a][2] is not None and rows[a][2] == rows[b][2]
               and u[a] is not None and u[b] is not None and len(u[a]) == len(u[b]) and u[a] @ u[b] >= 0.98]
              for a in range(len(rows))]
    home = list(range(len(rows)))
    change = True
    while change:
        change = False
        for a in range(len(rows)):
            m = min([home[a], *[home[b] for b in linked[a]]])
            change |= m < home[a]
            home[a] = m
    least = {}
    for k, h in enumerate(home):
        if rows[k][0] is not None:
            least[h] = min(least.get(h, 10 ** 9), rows[k][0])
    want = Counter((rows[k][0], len(linked[k]), least.get(home[k]), rows[k][0] == least.get(home[k]))
                   for k in range(len(rows)))
    got = bag(embeddings.near_duplicates(df, block=32).select("vec_id", "n_links", "component_id", "kept").collect())
    assert got == want
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


# 6 token files

def test_token_files(docs, empty, spark, tmp_path):
    from tokenizers import Tokenizer
    path = tokenizer_file("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    known = docs.where("doc_id IS NOT NULL")
    tokenfile.write(known, str(tmp_path / "t"), path, end_id=1, shard=3000)
    got = tokenfile.read(spark, str(tmp_path / "t")).collect()
    at, want = 0, Counter()
    def tie(text):  # the engine's hash of a string, as a signed number; of null it is the seed
        h = 42 if text is None else xxhash.xxh64_intdigest(text.encode(), 42)
        return h - (1 << 64) if h >> 63 else h

    for i, t in sorted(((i, t) for i, t in TEXTS if i is not None), key=lambda r: (r[0], tie(r[1]))):
        t = t or ""
        ids = library.encode(t, add_special_tokens=False).ids + [1]
        want[i, at, zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
        at += len(ids)
    assert Counter((r["doc_id"], r["start"], zlib.crc32(bytes(r["ids"]))) for r in got) == want
    tokenfile.write(docs, str(tmp_path / "n"), path, end_id=1)
    assert tokenfile.read(spark, str(tmp_path / "n")).count() == len(TEXTS)
    tokenfile.write(empty, str(tmp_path / "e"), path, end_id=1)
    assert tokenfile.read(spark, str(tmp_path / "e")).count() == 0


def test_grammar():
    rng = np.random.default_rng(1)
    for ids in ([], [7], [3] * 999, rng.integers(0, 30, 20_000).tolist(), (rng.zipf(1.5, 9000) % 900).tolist()):
        ids = np.array(ids, "<u4")
        r, s = tokenfile.repair(ids, 1000)
        shard = tokenfile.Shard(1000, r.tobytes(), s.tobytes(), tokenfile.rule_lengths(r, 1000).tobytes())
        assert (shard.read() == ids).all() and len(s) <= len(ids)
        for a in range(0, len(ids), 1777):
            assert (shard.read(a, a + 300) == ids[a:a + 300]).all()
    assert len(tokenfile.repair(np.full(4096, 3, "<u4"), 1000, least=16)[1]) < 32


# 7 suffixes

def brute_cut(texts):
    data = [(t or "").encode() for t in texts]
    n = Counter(d[p:p + 200] for d in data for p in range(len(d) - 199))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for p in range(len(d) - 199):
            if n[d[p:p + 200]] > 1:
                gone[p:p + 200] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(d), int(gone.sum()), spans, np.frombuffer(d, np.uint8)[~gone].tobytes()))
    return out


@pytest.mark.parametrize("held", [20_000, 3])
def test_suffixes(docs, empty, spark, held, monkeypatch):
    want = Counter((i, *x) for (i, _), x in zip(TEXTS, brute_cut([t for _, t in TEXTS])))
    got = suffixes.deduplicated(docs).collect()
    assert Counter((*r[:4], bytes(r["kept"])) for r in got) == want
    assert suffixes.deduplicated(empty).count() == 0


def test_suffix_edges(spark):
    core, texts = "".join(R.choice("abcdefgh") for _ in range(700)), []
    for k in range(60):
        a = R.randint(0, 450)
        texts.append("".join(R.choice("xyz") for _ in range(R.randint(0, 90))) + core[a:a + R.randint(150, 260)]
                     + "".join(R.choice("xyz") for _ in range(R.randint(0, 90))))
    texts += ["ab" * 300, "q" * 199, "q" * 200, "é" * 150, core[:200], core[:199]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (*r[1:4], bytes(r["kept"])) for r in suffixes.deduplicated(df).collect()}
    assert [got[k] for k in range(len(texts))] == brute_cut(texts)


def test_suffix_groups_across_boundaries():
    """Buckets told in parts must still give every repeat, by ranges or by hashes."""
    import pyarrow as pa
    text = ("".join(R.choice("abcdefgh") for _ in range(260))).encode()
    rows = [(1, 2, 0, k, 0, 0, 10, False, text[5:15], text[159:215][:56]) for k in range(9)]
    names = ["core", "core2", "__file", "__row", "base", "low", "high", "rep", "left", "right"]
    batch = pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows])
    old, suffixes.HELD = suffixes.HELD, 1
    try:
        out = [r for b in suffixes._compare([batch]) for r in b.to_pylist()]
    finally:
        suffixes.HELD = old
    pending = [r for r in out if r["h1"] is not None]
    assert {r["__row"] for r in pending} == set(range(9))
    n = Counter((r["h1"], r["h2"]) for r in pending)
    assert set(n.values()) == {9} and len(n) == 11


# 8 toxicity

def test_toxicity(spark, docs, empty):
    insults, rows, labels = ["moronic", "trashy", "scummer"], [], []
    for k in range(900):
        bad = k % 4 == 0
        words = prose(60).split(" ")
        if bad:
            for w in insults:
                words.insert(R.randint(0, 50), w)
        rows.append((k, " ".join(words)))
        labels.append((k, int(bad)))
    rows += [(5000, "you m0r0n1c tr@shy t h i n g, scuuuummer"), (5001, "plain prose of the kind"), (5002, None), (5003, "")]
    labels += [(5000, None), (None, 1), (5002, 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    l = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(d, l).collect()}
    right = sum((got[k] >= 0.7) == bool(y) for k, y in labels[:900] if zlib.crc32(str(k).encode()) % 3 == 1)
    held = sum(zlib.crc32(str(k).encode()) % 3 == 1 for k in range(900))
    assert right >= 0.97 * held
    assert got[5000] >= 0.7 and got[5001] < 0.3 and got[5002] == got[5003] < 0.3
    assert toxicity.scored(empty, l).count() == 0
    none = toxicity.scored(docs, l.limit(0)).collect()
    assert len(none) == len(TEXTS) and all(0 <= r["score"] < 0.01 for r in none)


def test_restored_words(spark):
    text = "the idiot and the loser met a moron in the trash with a clown, stupid and worthless. " * 50
    model = toxicity.character_model(spark.createDataFrame([(text,)], "text string"))
    r = toxicity.Restorer(model)
    for seen, meant in (("1d10t", "idiot"), ("l0ser", "loser"), ("m0r0n", "moron"), ("trrrash", "trash"),
                        ("i.d.i.o.t", "idiot"), ("$tupid", "stupid"), ("The", "the"), ("2024", "2024")):
        assert r.word(seen) == meant
    assert r.spaced("he is an i d i o t. so") == ["idiot"]


# 9 line dedup

def test_lines(docs, empty, spark):
    order = sorted(range(len(TEXTS)), key=lambda k: (TEXTS[k][0] is None, TEXTS[k][0] or 0))
    seen, gone = set(), {}
    for k in order:
        lines = (TEXTS[k][1] or "").split("\n")
        spoken = [j for j, x in enumerate(lines) if runs(x)]
        places = [(j,) for j in spoken if len(runs(lines[j])) >= 50] + list(zip(spoken, spoken[1:]))
        for at in sorted(places):
            name = tuple(lines[j] for j in at)
            if name in seen:
                gone.setdefault(k, set()).update(at)
            seen.add(name)
    want = Counter()
    for k, (i, t) in enumerate(TEXTS):
        lines = t.split("\n") if t is not None else []
        left = "\n".join(x for j, x in enumerate(lines) if j not in gone.get(k, ()))
        want[i, t if t is None else left, len(lines), len(gone.get(k, ()))] += 1
    out = linededup.line_deduplicated(docs, emptied=True, counts=("n", "removed"))
    # rows with one id may swap places: what is compared is the table as a whole
    assert bag(out.select("doc_id", "text", "n", "removed").collect()) == want
    assert out.columns == [*docs.columns, "n", "removed"]
    assert linededup.line_deduplicated(empty).count() == 0
    assert linededup.line_deduplicated(docs).where("doc_id = 17").count() <= 1


def test_clashing_columns(docs, empty):
    """Names that operators use themselves, as columns of the table."""
    names = ["__file", "__row", "__removed", "__gone", "__cut", "__k", "__times", "c0", "doc", "id", "none", "fp", "at",
             "f", "sides", "part", "least", "size", "copies", "__m", "__words", "__lines", "__ledger", "row", "tie"]
    wide = docs.select("*", *[F.lit("own").alias(n) for n in names if n not in docs.columns])
    own = [n for n in names if n not in docs.columns]
    for op in (rules.filtered, linededup.line_deduplicated, simhash.deduplicated, mixing.mixture):
        out = op(wide)
        assert out.columns == wide.columns
        assert bag(out.select("doc_id", "text").collect()) == bag(op(docs).select("doc_id", "text").collect())
        assert out.select(*own).distinct().count() == 1
