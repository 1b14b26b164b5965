import base64

import public_tokenizers as public
import pytest
import tiktoken

from . import brute

SF = "/root/testdata/sf0.001"


def test_stages_by_plain_versions(spark):
    """Every stage on what the one before kept, against plain versions of the operators."""
    import corpus_pipeline as p
    from tessellum.llm import toxicity

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    kept = {}
    for name, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == names
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept[name] = {x.doc_id: x.text for x in docs.collect()}
    whole = spark.read.parquet(f"{SF}/documents.parquet")
    score = {x.doc_id: x.score for x in toxicity.scored(whole, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert set(kept["toxicity"]) == {d for d, s in score.items() if s < 0.7}
    groups = brute.simhash(list(kept["toxicity"].items()))
    assert set(kept["near_copies"]) == {c for _, _, c in groups}
    items = [tuple(x) for x in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    hit = {x[0] for x in brute.contained(list(kept["near_copies"].items()), items)}
    assert hit and set(kept["benchmark"]) == set(kept["near_copies"]) - hit
    changed = {d for d, t in kept["secrets"].items() if t != kept["benchmark"][d]}
    assert set(kept["secrets"]) == set(kept["benchmark"])
    assert changed == {d for d, t in kept["benchmark"].items() if any(brute.secrets(t)[:3])}
    assert not any(any(brute.secrets(t)[:3]) for t in kept["secrets"].values())
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    e = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((d, len(i := e.encode_ordinary(t)), brute.sha(",".join(map(str, i)).encode()), brute.sha(t.encode())) for d, t in kept["secrets"].items())
    assert sorted(map(tuple, p.run(spark, SF).collect())) == want


def test_odd_rows_pass_every_stage(spark):
    import corpus_pipeline as p

    names = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, None, None, None, None), (1, None, "en", None, 0), (1, "", None, "s", 0), (2, "plain words " * 30, "en", "s", 5), (2, "plain words " * 30, "en", "s", 5), (3, "x " * 30_000, "en", "s", 1)]
    for docs in (spark.createDataFrame(rows, names), spark.createDataFrame([], names)):
        n = docs.count()
        for _, stage in p.STAGES:
            docs = stage(spark, docs, SF)
        out = docs.collect()
        assert len(out) == (3 if n else 0)  # all without words are one group, and equal rows another


def test_clashing_columns_stay(spark):
    import corpus_pipeline as p

    names = ["_did", "_th", "_nth", "_kinds", "_own", "fp", "anchor", "trusted", "score", "did", "th"]
    docs = spark.createDataFrame([(1, "plain words stand here for a while now", *range(11))], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    for _, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    assert [tuple(x) for x in docs.collect()] == [(1, "plain words stand here for a while now", *range(11))]


def test_near_copies_ties(spark):
    from tessellum.llm.simhash import without_near_copies

    a, b = "one two three four five six seven", "quite other words stand here indeed now"
    df = spark.createDataFrame([(5, a), (5, a), (5, b), (None, a), (None, "alone here"), (9, b)], "doc_id long, text string")
    assert sorted(map(repr, map(tuple, without_near_copies(df).collect()))) == sorted(map(repr, [(5, a), (5, b), (None, "alone here")]))


@pytest.mark.parametrize("name", ["pipeline"])
def test_registered(spark, name):
    import __spark_entry__

    assert __spark_entry__.queries()[name](spark, SF).count() > 0
