import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, id string, h long, size int, `row` string"


def corpus() -> list[tuple]:
    """Rows with the cases that every operator must stand: NULLs, empty and long texts, ties, repeats, clashing columns."""
    rng = random.Random(5)
    stems = {
        "en": "the of and house water people under nothing stone garden".split(),
        "fr": "le la des maison eau été forêt où très jardin".split(),
        "de": "der die und häuser straße über grün wasser nichts garten".split(),
    }

    def prose(lang, n):
        return " ".join(rng.choice(stems[lang]) + rng.choice(["", "s", "en", "ly", ",", "."]) for _ in range(n))

    texts = [(prose(lang, rng.randint(1, 200)), lang) for lang in stems for _ in range(16)]
    base = prose("en", 150)
    passage = prose("de", 70)
    texts += [(base, "en")] * 4 + [(base[:-1] + "!", "en"), (base.upper(), "en"), (base + " stone", None)]
    texts += [(prose("fr", 40) + passage + prose("fr", 30), "fr"), (prose("de", 60) + passage + prose("de", 10), "de")]
    texts += [("\n".join([prose("en", 5)] * 6 + [prose("en", 9)]), "en"), ("a " * 400, "en"), ("ab" * 700, "xx")]
    texts += [(None, None), ("", "en"), ("   \n\t ", "fr"), ("123 456 !!! ###", "de"), ("<|endoftext|> the<|endoftext|>", "en")]
    texts += [("日本語の文章 가나다 \U0001f600 é ᚠᛇ ﷺ  x", "ja"), ("word word　word  \n  end", "en"), (prose("en", 9000), "en")]
    texts += [(f"{prose('en', 30)} idiot {prose('en', 5)} scum, loser {prose('en', 20)}", "en") for _ in range(8)]
    rows = [(i * 3 - 9, t, lang, f"s{i % 5}" if i % 7 else None) for i, (t, lang) in enumerate(texts)]
    rows += [rows[0], rows[0], (None, texts[1][0], "en", "s1"), (None, "only here once", None, None), (rows[4][0], "other text of an old id", "en", "é")]
    return [(*r, len(r[1] or ""), "x", 1, 2, "y") for r in rows]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).repartition(5).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)


def key(row) -> tuple:
    return tuple((v is not None, v) for v in row)


def same_rows(df, expected) -> None:
    """``df`` has exactly the rows ``expected``, in any order."""
    assert sorted(map(tuple, df.collect()), key=key) == sorted(expected, key=key)
