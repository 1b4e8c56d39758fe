import random

import pytest

WORDS = "the of and river stone house window garden letter market silver morning quiet engine forest paper winter candle bridge music".split()
FREMD = "der die und ist nicht haus fenster garten brief markt silber morgen ruhig wald papier kerze schiff kraft lange schule".split()


@pytest.fixture(scope="session")
def make():
    """Documents with nulls, empty and short texts, copies, near copies, a long text, repeated rows and a shared passage."""

    def prose(rng, n, words=WORDS):
        return " ".join(rng.choice(words) + str(rng.randrange(60)) * (rng.random() < 0.7) for _ in range(n))

    def build(seed=0):
        rng = random.Random(seed)
        passage = prose(rng, 30)
        texts = [prose(rng, rng.randrange(20, 90)) for _ in range(24)]
        texts += [texts[0], texts[0], texts[3].upper(), texts[5] + " extra", "changed " + texts[5], None, "", " \t ", "one", "one two", "one two three"]
        texts += [prose(rng, 20) + " " + passage + " " + prose(rng, 9) for _ in range(3)]
        texts += [prose(rng, 3000), "\n".join([prose(rng, 12), passage, prose(rng, 12), passage + " tail"]), passage, "日本語 テキスト 𓀀𓁐", "   lead", "1234 !!"]
        langs = ["en", "de", None]
        return [(i * 7 % 101, t, langs[i % 3], f"src{i % 3}" if i % 5 else None, 0 if t is None else len(t)) for i, t in enumerate(texts)]

    build.prose = prose
    return build


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark, make):
    return spark.createDataFrame(make(), SCHEMA)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
