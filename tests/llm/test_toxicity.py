"""The whole toxicity query against a plain re-scoring, and misspelled and quoted insults that the sample doesn't have."""

import math

import numpy as np

SF = "/root/testdata/sf0.001"


def rows(a: str, b: str) -> list[int]:
    """Edit distance of ``a`` to each prefix of ``b``."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row


def plain_score(made_of, w, text: str) -> float:
    from tessellum.llm.toxicity import CREDIT, DENSE, TOKEN, budget, quoted, stem_budget

    words, stems, innocent, worth, credit = made_of
    low = text.lower()
    best, total, n = [0.0] * 4, [0.0] * 4, 0
    for m in TOKEN.finditer(low):
        n += 1
        if m[0] in innocent:
            continue
        found = [(d, i) for i, t in enumerate(words) if (d := rows(t, m[0])[-1]) <= budget(t)]
        found += [(d, len(words) + i) for i, s in enumerate(stems) if (d := min(rows(s, m[0]))) <= stem_budget(s)]
        if found:
            d, i = min(found)
            k, value = 2 * (d > 0) + quoted(low, m.start(), m.end()), worth[i] * (credit[i] if d else 1)
            best[k] = max(best[k], value)
            total[k] += value
    sums = [min(math.expm1(2.0), t / max(1, n / DENSE)) for t in total]
    x = [1.0]
    for k in (0, 1):
        x += [max(best[k], CREDIT * best[k + 2]), math.log1p(sums[k] + CREDIT * sums[k + 2])]
    return 1 / (1 + math.exp(-float(np.dot(x, w))))


def test_query_by_plain_scoring(spark):
    from tessellum.llm.queries import op4_toxicity
    from tessellum.llm.toxicity import fit

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    made_of, w = fit(docs, labels, folds=3, fold=1)
    got = {x.doc_id: x.score for x in op4_toxicity(spark, SF).collect()}
    want = {x.doc_id: plain_score(made_of, w, x.text[:4000]) for x in docs.collect() if len(x.text) <= 4000}
    assert len(want) > 100 and all(abs(got[d] - s) < 1e-9 for d, s in want.items())


def planted(n: int = 240):
    """Labelled texts whose insults are all spelled well, with a few quoted ones among the clean."""
    insults = ["wretched", "numbskull", "blockhead", "nitwitted"]
    rows, labels = [], []
    for i in range(n):
        body = [f"{a}{(i * 7 + k * 13) % 97}" for k, a in enumerate(["plain", "words", "stand", "here", "while", "others", "wander", "around", "quietly", "again"])]
        toxic = i % 3 == 0
        if toxic:
            body[3:3] = ["you", insults[i % 4]]
            body.append(insults[(i // 3) % 4])
        elif i % 15 == 1:
            body += ["they", "said", f'"{insults[i % 4]}"', "yesterday"]
        rows.append((i, " ".join(body)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_misspelled_and_quoted(spark):
    from tessellum.llm.toxicity import scored

    rows, labels = planted()
    asked = {
        1000: ("you numbskul and wrtched one, go away", 1),
        1001: ("you blockhed, you nitwited fool", 1),
        1002: ("you wretched numbskull, go away", 1),
        1003: ("he said \"numbskull\" once", 0),
        1004: ("he said \"numbskul\" once", 0),
        1005: ("nothing of the kind stands here", 0),
    }
    docs = spark.createDataFrame([*rows, *((d, t) for d, (t, _) in asked.items())], "doc_id long, text string")
    got = {x.doc_id: x for x in scored(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert {d: got[d].predicted for d in asked} == {d: y for d, (_, y) in asked.items()}
    assert got[1000].score <= got[1002].score and got[1004].score <= got[1002].score


def test_stems_by_prefix_distance():
    import random

    from tessellum.llm.toxicity import Lexicon, stem_budget

    r = random.Random(4)
    stems = ["abcabcab", "ccbbaac", "bac"]
    lexicon = Lexicon([], stems)
    for _ in range(2000):
        w = list(r.choice(stems)) + [r.choice("abc") for _ in range(r.randint(0, 4))]
        for _ in range(r.randint(0, 2)):
            at = r.randrange(len(w) + 1)
            w[at : at + r.randint(0, 1)] = r.choice(["", "a", "b", "c", "g"])
        w = "".join(w)
        want = min((d for s in stems if (d := min(rows(s, w))) <= stem_budget(s)), default=None)
        got = lexicon.match(w)
        assert (got[0] if got else None) == want, w


def test_sample_without_copies():
    from tessellum.llm.toxicity import unlike

    text = " ".join(f"unusual{i}" for i in range(30))
    near, other = text.replace("unusual3 ", "changed "), " ".join(f"different{i}" for i in range(30))
    assert unlike([(text, 1), (near, 1), (text, 0), (other, 1), ("a b", 0), ("b a", 0), ("a c", 0)]) == [(text, 1), (text, 0), (other, 1), ("a b", 0), ("a c", 0)]


def test_odd_texts(spark):
    """Empty, white and very long texts, repeated rows and a clashing column."""
    from tessellum.llm.toxicity import scored, without_toxic

    rows, labels = planted()
    odd = [(None, None), (2000, ""), (2001, " \n\t"), (2002, "you numbskull " * 50_000), (2003, "x" * 300_000), (2004, "é" * 1000), (2004, "é" * 1000)]
    docs = spark.createDataFrame([(d, t, 1.0) for d, t in [*rows, *odd]], "doc_id long, text string, score double")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = scored(docs, marks).where("doc_id IS NULL OR doc_id >= 2000").collect()
    assert len(got) == len(odd) and {x.doc_id for x in got if x.predicted} == {2002}
    kept = without_toxic(docs, marks)
    assert kept.columns == docs.columns and kept.where("doc_id IS NULL OR doc_id >= 2000").count() == len(odd) - 1
    assert without_toxic(docs.limit(0), marks).count() == scored(docs.limit(0), marks).count() == 0
