"""The stored table of prefix counts against the tokenizer itself, asked again for every prefix."""

import random
import sys
import time

import public_tokenizers
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "It's don't 'round we'll 'tis ''s",
    "<|endoftext|> a<|startoftext|>b <|endoftext|><|endoftext|>",
    "überstraße 12 日本 🙂 a!!'s   \n tabs\t\tand  blanks  ",
    "unfathomableness antidisestablishmentarianism fooled fool foo",
    "<|endoftext <|end| <| |>",
    " ",
    "",
]


def counts(t: Tokenizer, text: str) -> list[int]:
    return [len(t.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]


def test_every_prefix():
    from tessellum.llm.token_counts import PrefixCounter

    t, c, r = Tokenizer.from_file(PATH), PrefixCounter(PATH), random.Random(6)
    bits = ["a", "the", "ing", "'s", "'", "!", "é", "日", " ", "\n", "9", "ology", "<|endoftext|>", "🙂"]
    for text in [*TEXTS, *("".join(r.choice(bits) for _ in range(r.randint(1, 30))) for _ in range(150))]:
        assert c.prefix_counts(text) == counts(t, text), text
        assert c.count(text) == counts(t, text)[-1]


def test_budgets_from_the_stored_table(spark, tmp_path):
    from tessellum.llm.token_counts import budgets, prefix_table

    rows = [*enumerate(TEXTS), (None, None), (50, TEXTS[0]), (50, TEXTS[0])]
    docs = spark.createDataFrame([(d, x, 1) for d, x in rows], "doc_id long, text string, steps int")
    prefix_table(docs, PATH).write.parquet(str(tmp_path / "table"))
    stored = spark.read.parquet(str(tmp_path / "table"))
    limits = [0, 1, 3, 7, 1000]
    t, want = Tokenizer.from_file(PATH), []
    for d, x in rows:
        each = counts(t, x or "")
        for b in limits:
            fit = next((i - 1 for i, n in enumerate(each) if n > b), len(each) - 1)
            want.append((d, b, fit, fit < len(x or "")))
    assert sorted(map(str, map(tuple, budgets(stored, limits).collect()))) == sorted(map(str, want))
    assert {(x.doc_id, x.n_tokens) for x in stored.collect()} == {(d, counts(t, x or "")[-1]) for d, x in rows}
    assert budgets(stored.limit(0), limits).count() == prefix_table(docs.limit(0), PATH).count() == 0


def test_fit_of_the_query(spark):
    from tessellum.llm.token_counts import PrefixCounter, token_counts

    long_ = "the cat sat on the mat and '!? " * 300
    got = {x.doc_id: x for x in token_counts(spark.createDataFrame([(1, long_), (2, "short")], "doc_id long, text string"), PATH, 100).collect()}
    c = PrefixCounter(PATH)
    assert got[1].over_limit and got[1].n_chars_fit == c.fits(long_, 100) < len(long_) and c.prefix_counts(long_)[got[1].n_chars_fit] <= 100
    assert not got[2].over_limit and got[2].n_chars_fit == 5


def test_new_pretokens_cost_few_calls():
    """Pretokens met for the first time, whose tokens and pairs have mostly been met: a few calls each, not some at every byte."""
    from tessellum.llm.token_counts import PrefixCounter

    r = random.Random(8)
    bits = "the and tion ing er re on at en ción".split()
    words = sorted({"".join(r.choice(bits) for _ in range(r.randint(3, 6))) for _ in range(30_000)})
    r.shuffle(words)
    c, calls = PrefixCounter(PATH), 0
    c.count(" ".join(words[2000:]))

    def called(frame, event, arg):
        nonlocal calls
        calls += event == "call"

    sys.setprofile(called)
    try:
        n = c.count(" ".join(words[:2000]))
    finally:
        sys.setprofile(None)
    assert n == len(Tokenizer.from_file(PATH).encode(" ".join(words[:2000]), add_special_tokens=False).ids)
    assert calls < 8 * 2000


def test_small_tables():
    """Tables that overflow inside a pretoken change no count, and hold no more than allowed."""
    from tessellum.llm.token_counts import PrefixCounter

    t, c, r = Tokenizer.from_file(PATH), PrefixCounter(PATH, keep=30), random.Random(9)
    texts = [*TEXTS, "".join(r.choice("abcdeéñ日") for _ in range(300)), "antidisestablishmentarianism" * 8]
    for text in texts:
        assert c.prefix_counts(text) == counts(t, text), text
        assert sum(map(len, (*c.states.values(), *c.afters.values()))) <= c.met <= 30


def test_separators_are_no_white_space():
    from tessellum.llm.token_counts import PrefixCounter

    t, c = Tokenizer.from_file(PATH), PrefixCounter(PATH)
    for text in ("\x1c", "a\x1fb", "\x1c!", " \x1d? a", "\x1c\x1e 's", "\x85a\u2028b\u3000\x1d"):
        assert c.prefix_counts(text) == counts(t, text), text


def test_runs_that_begin_with_an_apostrophe():
    from tessellum.llm.token_counts import PrefixCounter

    t, c = Tokenizer.from_file(PATH), PrefixCounter(PATH)
    for text in ["'" * 60, "'-" * 40, "''s 'tis", "'!?x", "a'" + "'," * 30 + "'re", "'d'", "'é", "'٣"]:
        assert c.prefix_counts(text) == counts(t, text), text
    began = time.process_time()
    assert c.count("'" * 200_000) == len(t.encode("'" * 200_000, add_special_tokens=False).ids)
    assert c.count("'-" * 100_000) > 0
    assert time.process_time() - began < 4
