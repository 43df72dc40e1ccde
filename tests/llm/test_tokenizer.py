import base64
import random
from pathlib import Path

import pytest

from sievework.llm.tokenizer import PATTERN, VOCABULARY, Encoder, encode, encode_texts

pytestmark = pytest.mark.skipif(not Path(VOCABULARY).exists(), reason="no vocabulary here")


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_same_ids_as_the_public_library(reference):
    rnd = random.Random(1)
    texts = ["", "a", "Hello world, it's we'll", "aaaa" * 500, " \n\n  x", "ß" * 300, "日本語のテキスト" * 50, "<|endoftext|>", "🙂🙂 a", "".join(rnd.choice("abcdehilt") for _ in range(3000)), "x́  y"]
    texts += ["".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(160, 600), 0x20, 0x0A])) for _ in range(rnd.randrange(1, 200))) for _ in range(200)]
    got = encode_texts(texts, Encoder(), {})
    assert [list(map(int, g)) for g in got] == [reference.encode_ordinary(t) for t in texts]


def test_round_trip(reference):
    text = "Mes chers collègues — 3.5 %\tüber\r\n" * 40
    (ids,) = encode_texts([text], Encoder(), {})
    assert reference.decode(list(map(int, ids))) == text


def test_frame_with_nulls_repeats_empty_and_clashing_names(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "a b", None), (3, "a b", None)], "k0 long, text string, t string")
    got = encode(df, keep=["k0"])
    assert got.columns == ["k0", "ids"] and sorted((r.k0, list(r.ids)) for r in got.collect()) == [(1, []), (2, []), (3, [64, 275]), (3, [64, 275])]
    assert encode(df.limit(0), keep=["k0"]).count() == 0
    assert sorted(r.n_tokens for r in encode(df, keep=["k0"], counts_only=True).collect()) == [0, 0, 2, 2]
