"""Small tables with what goes wrong in large ones: nulls, empty and long texts, repeated rows, clashing columns."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, size long, __id string, rule_statistics string"
WORDS = "the of and thing stone river over under light dark house tree green walk talk slow quick brown fox dog lazy moon sun day night".split()


def prose(rng, n, words=WORDS):
    out = []
    for i in range(n):
        out.append(rng.choice(words) + ("." if i % 11 == 10 else "") + ("\n" if i % 37 == 36 else ""))
    return " ".join(out)


def odd_texts():
    rng = random.Random(9)
    return [
        None, "", " ", "\n\t \n", "a", "one two", "One TWO", "é ü ñ ß 日本語 😀 x", "a b c", "tab\tand\x0bvt\x0cff\rcr", "x" * 30_000, prose(rng, 20_000), "same line\nsame line\nsame line\n\n\nother",
        "a b c d e f g h i a b c d e f g h i", "w " * 40, "<s>[INST] hi [/INST]</s> \\ <\\s> [\\\\INST]", "'s 'll don't I'VE  double  blanks \n nl", "$$$ *** ### %%% &&& ||| <<< >>>", "\x00 nul \x1c fs",
        "same line\nsame line\nsame line\n\n\nother",
    ]


def docs(spark, texts=None, sources=("b", "a", None, "é", "B")):
    texts = odd_texts() if texts is None else texts
    rows = [(i, t, "en", sources[i % len(sources)], None, 0.5, 7, 3, "clash", "clash") for i, t in enumerate(texts)]
    if len(texts) > 5:
        rows += [rows[5], rows[5], (None, "no id", None, None, 1, None, None, None, None, None), (-3, None, None, "a", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")
