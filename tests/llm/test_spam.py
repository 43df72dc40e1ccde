import random

from sievework.llm.spam import blocks, measure, sentences, spam_pages

SPEECH = [
    "I am glad that the bridge beside the market has been paid for by the millers of this town, and I say so plainly.",
    "We told the Committee before the recess that no school in the valley would reach the standard that was promised.",
    "Some will say that the estimate was drafted in haste; I say that every clause of it deserves a careful reading.",
    "Let me turn to the harbour, which is not before us today but will come back to this House within the year.",
]


def speech(i):
    return " ".join(SPEECH[(i + j) % 4].replace("bridge", f"bridge number {i * 7 + j}") for j in range(4))


def name(i):
    rnd = random.Random(i)
    return "".join(rnd.choice("abcdefghijklmnoprstuvwyz") for _ in range(rnd.randrange(5, 12))).capitalize()


def flagged(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, words string")
    return {r.doc_id for r in spam_pages(df).filter("is_spam").collect()}


def test_lists_are_spam_speeches_and_house_papers_are_not(spark):
    rows = [(i, speech(i), "en", "x") for i in range(40)]
    rows += [
        (100, "\n".join(f"https://shop.cheap-deal{i % 3}.test/best-offer?id={i}" for i in range(40)), "en", None),
        (101, "loan casino roof, loan roof, casino loan, " * 40, "en", None),
        (102, " / ".join(["2008", "Previous", "Archive", "Next", "Login", "2011"] * 20), None, None),
        (103, "Best loan online. Cheap! Cheap! sofa! Our loan sofa, your loan sofa. " * 20, "en", None),
        (200, "\n".join(f"{i}. Harbour Dues (Report Stage) .......... {i * 7}" for i in range(1, 40)), "en", None),
        (201, "Division No. 4\nAYES: 30\n" + "; ".join(f"{name(i).upper()}, {chr(65 + i % 20)}." for i in range(60)), "en", None),
        (202, "\n".join(f"{name(i)} {name(i + 500)} | {i * 3797 % 1000} | {i * 77 % 100}.{i % 10}%" for i in range(40)), "fr", None),
        (203, SPEECH[2] + " " + (SPEECH[2] + " ") * 30, "en", None),
        (204, speech(3) + " Buy cheap loans online at best-loan.test today.", "en", None),
    ]
    assert flagged(spark, rows) == {100, 101, 102, 103}


def test_nulls_blanks_short_long_and_repeated_rows(spark):
    rows = [(1, None, "en", None), (2, "", "en", None), (3, " \n ", None, None), (4, "loan", "en", None), (5, "casino loan " * 60_000, "en", None), (5, "casino loan " * 60_000, "en", None), (6, "x" * 300_000, "zz", None)]
    got = flagged(spark, rows + [(i, speech(i), "en", None) for i in range(10, 40)])
    assert 5 in got and not got & {1, 2, 3, 4}
    assert flagged(spark, []) == set()


def test_blocks_keep_every_character():
    text = "line one is here\n" * 30 + "y" * 5000 + "\n" + "word " * 900
    assert "".join(blocks(text, 400)) == text and max(map(len, blocks(text, 400))) <= 1200


def test_sentences_and_redundancy_across_blocks():
    assert sentences("The road was closed. At 3.5 km it is open to all of us now. loan sofa. (see https://a.test/1)") == (16, 2, 1)
    page = "\n".join(f"{w} sale {v} offer" * 6 for w in "abcdefgh" for v in "pqrs")
    alone, after = [b[3] for b in measure(page, 400, 0)], [b[3] for b in measure(page, 400, 20)]
    assert sum(after) < 0.75 * sum(alone) and len(alone) == measure(page, 400, 20).__next__()[0]


def test_the_compression_ratio_decides(spark):
    """Pages without sentences, half of them redundant: without the ratio all would be flagged."""
    rnd = random.Random(1)
    rows = [(i, speech(i), "en", None) for i in range(60)]
    rows += [(100 + i, "; ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(80)), "en", None) for i in range(5)]
    rows += [(200 + i, f"loan casino {i} roof, loan roof, casino loan, " * 20, "en", None) for i in range(5)]
    assert flagged(spark, rows) == {200 + i for i in range(5)}
