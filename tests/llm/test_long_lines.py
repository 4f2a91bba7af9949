"""Passages that stand on one line, in the line stage of the pipeline."""

import random

import corpus_pipeline
from brinelake.llm import linededup
from brinelake.llm.common import written


def test_long_single_lines_go(spark):
    rng = random.Random(9)

    def line(n):
        return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))

    long, edge, short, two = line(80), "  " + line(50) + "\t ", line(49), [line(9), line(9)]
    texts = [line(20) + "\n" + long + "\n" + line(20), long, "\n".join([line(5), "", edge, line(5)]),
             "\n".join([line(70), long, line(7), edge]), "\n".join([short, line(5)]), "\n".join([line(5), short]),
             "\n".join([*two, line(60)]), "\n".join([line(60), *two, long]), short, "\n".join([edge, long, "x"]), None, ""]
    seen, want = set(), {}
    for k, t in enumerate(texts):
        lines = (t or "").split("\n")
        spoken = [j for j, x in enumerate(lines) if x.split()]
        places = [(j,) for j in spoken if len(lines[j].split()) >= 50] + list(zip(spoken, spoken[1:]))
        gone = set()
        for at in sorted(places):
            name = tuple(lines[j] for j in at)
            if name in seen:
                gone.update(at)
            seen.add(name)
        left = "\n".join(x for j, x in enumerate(lines) if j not in gone)
        if not gone or left.split():
            want[k] = t if t is None else left
    assert 1 not in want and short in want[8] and long not in want[3] + want[7] + want[9]
    rows = [(k, t, "en", "a", len(t or "")) for k, t in enumerate(texts)]
    docs = written(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"),
                   "test-long")
    stage = dict(corpus_pipeline.STAGES)["line dedup"]
    assert {r["doc_id"]: r["text"] for r in stage(spark, docs, "").collect()} == want
    short_too = linededup.line_deduplicated(docs, long=49).where("doc_id = 8")
    assert short_too.count() == 0  # a line of 49 words goes once it counts as long
