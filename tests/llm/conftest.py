import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, doc string, row string, rank string, spans string"


def rows(spark, pairs):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(d, t, "en", "src0", len(t or ""), "s", "d", "r", "k", "p") for d, t in pairs], DOCS)


def corpus(seed=1, n=60):
    """Texts with copies, near copies, shared passages and lines, secrets, nulls, ties and odd characters."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeiounrst") for _ in range(rng.randint(2, 7)))
    passage = " ".join(word() for _ in range(60))
    line = "  A common line that many documents hold\t"
    base = [word() for _ in range(150)]
    out = []
    for i in range(n):
        words = [word() for _ in range(rng.randint(1, 200))]
        kind = i % 9
        if kind == 0:
            words = list(base)
            for _ in range(rng.randint(0, 6)):
                words[rng.randrange(len(words))] = word()
        elif kind == 1:
            words[len(words) // 2 : len(words) // 2] = passage.split()
        text = "".join(w + rng.choice([" ", " ", " ", "\n", "  ", ". "]) for w in words)
        if kind == 2:
            text += "\n" + line + "\n" + line.upper()
        if kind == 3:
            text += f" api_key = '{word() * 6}' AKIA{'Q7' * 9} {'0f' * 12} token=short Secret: {'x' * 12}"
        if kind == 4 and out:
            text = out[rng.randrange(len(out))][1] or ""
        if kind == 5:
            text += " Été ÉTÉ été naïve 日本語 ſ İ \x0b\x0c \x85 x"
        out.append((i * 3 % 101, text))
    out += [(500, None), (501, ""), (None, passage), (502, " \n\t"), (503, "one"), (504, "one"), (505, passage), (505, passage), (506, passage.upper()), (507, "long " * 30_000 + passage)]
    return out


@pytest.fixture(scope="session")
def pairs():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, pairs):
    return rows(spark, pairs).repartition(5).cache()


@pytest.fixture(scope="session")
def none(spark):
    return rows(spark, [])


def same(got, want):
    key = lambda r: tuple((x is not None, x) for x in r)
    return sorted(map(tuple, got), key=key) == sorted(want, key=key)
