"""Words that hide in runs of single letters, in long tokens and behind look-alikes."""

import pytest

from brinelake.llm import toxicity


@pytest.fixture(scope="module")
def weigher(spark):
    text = ("you are an idiot and the loser met a moron in the trash with a clown, stupid and worthless. "
            "what a shame that scum is here, this is all the same to me and to the others, an ass. ") * 50
    model = toxicity.character_model(spark.createDataFrame([(text,)], "text string"))
    weights = {w: 5.0 for w in ("idiot", "idio*", "clown", "clow*", "scum", "ass", "moron", "moro*")}
    return toxicity.Weigher(toxicity.Restorer(model), weights)


@pytest.mark.parametrize("text", [
    "y o u a r e a n i d i o t", "t h i s i s a l l t h e s a m e t o m e a n d t o t h e o t h e r s y o u i d i o t s",
    "so y o u s c u m it is", "an a s s here", "i  d  i  o  t", "i - d - i - o - t", "i. d. i. o. t.",
    "idi" + "o" * 70 + "t", ".".join("i" * 1 + "d" + "i" + "o" + "t") + "." * 70, "-_".join("thatshamethatthesameidiotthatthesameother"),
    "!diot", "(lown", "m0r0n", "(idiot)", "scum!", "'clown'", "i d i o t and idiot"])
def test_found_once(weigher, text):
    assert weigher.total(text) == 2.5


@pytest.mark.parametrize("text", ["", None, "a b c", "t h i s i s t h e s a m e", "1 2 3 4", "same! (here) all+", "x" * 500,
                                  "_" * 500, "_ " * 500, "- " * 300 + "a" * 3, "/".join(["same", "here", "others"] * 12)])
def test_nothing_found(weigher, text):
    assert weigher.total(text) == 0.0


def test_every_place_of_a_long_run(weigher):
    for n in range(0, 140, 3):
        assert weigher.total(" ".join("e" * n + "idiot" + "e" * 60)) == 2.5
        assert weigher.total(".".join("he" * n + "idiot" + "he" * 60)) == 2.5
