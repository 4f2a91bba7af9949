"""The stages over a small table and the smallest given one."""

import os
import random
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from brinelake.llm import linededup, queries

FOLDER = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables are not here")


@needs_data
def test_pipeline(spark):
    docs = queries.table(spark, FOLDER, "documents")
    columns, n = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = linededup.written(stage(spark, docs, FOLDER), f"test-{k}")
        assert docs.count() > 0
        if k < 4:
            assert docs.columns == columns, name
        if k in (0, 2):
            assert docs.count() <= n
        if k == 1:
            assert docs.where(F.char_length("text") != F.col("n_chars")).count() == 0
        n = docs.count()
    assert docs.columns == ["doc_id", "source", "n_tokens", "ids", "decoded"]


def test_stages_on_nothing_and_nulls(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for rows in ([], [(None, None, None, None, None), (1, "", "en", "a", 0)]):
        docs = spark.createDataFrame(rows, schema)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = linededup.written(stage(spark, docs, FOLDER), f"none-{k}")
        assert docs.count() == 0


@needs_data
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_sql(spark, name):
    import duckdb
    from collections import Counter
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = queries.QUERIES[name](spark, FOLDER)
    cur = con.execute(queries.ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    right = Counter(tuple(r[names.index(c)] for c in df.columns) for r in cur.fetchall())
    assert Counter(tuple(r) for r in df.collect()) == right


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def keeps(t):
    """The current policy of the quality rules."""
    w = words_of(t)
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    again = len({i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)})
    lines = [x for x in (t or "").split("\n") if words_of(x)]
    twice = len(lines) - len(set(lines))
    return (len(w) >= 50 and 100 * again <= 50 * len(w) and 10 * sum(c in "#*$%&|<>" for c in t) <= 3 * len(w)
            and not (twice > 1 and 100 * twice > 40 * len(lines)) and 10 * t.count("!") <= 5 * len(w))


def less_repeats(rows):
    """Texts less later repeated runs of two lines and later repeated lines of 50 words."""
    seen, out = set(), {}
    for i, t in sorted(rows.items()):
        lines = t.split("\n")
        spoken = [j for j, x in enumerate(lines) if words_of(x)]
        gone = set()
        for at in sorted([(j,) for j in spoken if len(words_of(lines[j])) >= 50] + list(zip(spoken, spoken[1:]))):
            name = tuple(lines[j] for j in at)
            if name in seen:
                gone.update(at)
            seen.add(name)
        left = "\n".join(x for j, x in enumerate(lines) if j not in gone)
        if not gone or words_of(left):
            out[i] = left
    return out


def firsts(rows):
    """One text of each group within two bits of a fingerprint of three-word shingles."""
    def bits(t):
        w = words_of("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
        h = [xxhash.xxh64_intdigest(" ".join(w[k:k + 3]).encode(), 42) for k in range(len(w) - 2)]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = {i: bits(t) for i, t in rows.items()}
    home = {i: i for i in rows}
    for _ in rows:
        for a in rows:
            for b in rows:
                if (prints[a] ^ prints[b]).bit_count() <= 2:
                    home[a] = home[b] = min(home[a], home[b])
    return {i: rows[i] for i in rows if home[i] == i}


def test_run_against_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = random.Random(11)

    def prose(n):
        return " ".join(f"w{rng.randrange(10 ** 5)}" for _ in range(n))

    shared, long = "\n".join([prose(8), prose(9)]), prose(60)
    texts = ["\n".join([prose(30), shared, prose(30)]), "\n".join([prose(60), shared]), "\n".join([long, prose(80)]),
             "\n".join([prose(20), long]), long, prose(49), prose(50), "#" * 40 + prose(60), prose(60) + "!" * 200,
             "again and again " * 40, "", None, "\n".join([prose(30), "\n".join(["same", "line"] * 9), prose(9)])]
    base = prose(400)
    texts += [base, base.upper(), base + " ", "\n".join([prose(10), base])] + [prose(rng.randint(40, 300)) for _ in range(60)]
    rows = [(k, t, "en", ["a", "b", None][k % 3], len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{tmp_path}/documents.parquet")
    kept = firsts(less_repeats({k: t for k, t in enumerate(texts) if keeps(t)}))
    assert len(kept) < sum(keeps(t) for t in texts)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    library = Tokenizer.from_file(queries.tokenizer_file("byte_bpe_50k.json"))
    for r in got:
        assert r["decoded"] == kept[r["doc_id"]] and r["n_tokens"] == len(r["ids"])
        assert list(r["ids"]) == library.encode(kept[r["doc_id"]], add_special_tokens=False).ids
    times = Counter(r["doc_id"] for r in got)
    assert max(times.values()) <= 3
    sizes, taken = Counter(), Counter()
    for i, t in kept.items():
        sizes[rows[i][3]] += len(words_of(t))
        taken[rows[i][3]] += times[i] * len(words_of(t))
    share = {s: sum(sizes.values()) * w / 8 for s, w in (("a", 5), ("b", 2), (None, 1))}
    assert all(share[s] <= 3 * sizes[s] for s in share)  # so no excess to deal out again
    assert all(abs(taken[s] - share[s]) <= 300 for s in share), (taken, share)
