import random
import string

from . import brute

SF = "/root/testdata/sf0.001"


def frame(spark, rows, id_name="doc_id"):
    return spark.createDataFrame([(d, t, "x", 7) for d, t in rows], f"{id_name} long, text string, h string, kinds int")


def test_trigram_queries():
    from tessellum.llm.trigrams import query

    assert query("AKIA[A-Z0-9]+") == [[frozenset({"aki", "kia"})]]
    assert query("[0-9a-f]{24,}") == []
    got = query(r"(password|passwd|api_?key)\x20*=")
    assert len(got) == 1 and {frozenset({"api", "pik", "ike", "key"}), frozenset({"pas", "ass", "ssw", "swd"})} < set(got[0])
    assert query("(foo)?ba[a-z]+quux") == [[frozenset({"quu", "uux"})]]


def test_secrets_against_brute_force(spark):
    from tessellum.llm.secrets import BASE, scanned

    r = random.Random(2)
    bits = ["password", "PassWd", "secret", "ToKen", "api_key", "apikey", "=", ":", " ", "  ", '"', "'", "AKIA", "AKIA" + "Q7" * 9, "0123456789abcdef" * 2, "deadbeef", "\n", "é", "日", "🙂", "x", "hunter2", "a/b+c==", "ſecret", "toKen"]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randint(0, 25)))) for i in range(300)]
    rows += [(900, None), (901, ""), (902, "token=abcdef"), (902, "token=abcdef"), (903, "secret=token: abcdefgh"), (None, "AKIA" + "A" * 16), (904, "ab" * 5000)]
    got = sorted(tuple(-1 if v is None else v for v in x) for x in scanned(frame(spark, rows), BASE).collect())
    assert got == sorted(((-1 if d is None else d), *brute.secrets(t)) for d, t in rows)


def test_added_kinds_keep_base(spark):
    from tessellum.llm.secrets import scanned

    body = "".join(random.Random(1).choices(string.ascii_letters, k=36))
    got = scanned(frame(spark, [(1, f"a ghp_{body} token=abcdef -----BEGIN RSA PRIVATE KEY-----")])).first()
    assert (got.n_assign, got.base_sha256) == (1, brute.sha(b"assign:43:55"))
    assert got.spans == "github:2:42,assign:43:55,pem:56:87"


def test_secrets_on_table(spark):
    from tessellum.llm.queries import op5_secret_scan

    rows = {x.doc_id: x.text for x in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op5_secret_scan(spark, SF).collect()
    assert len(got) == len(rows)
    assert all((x.n_assign, x.n_access, x.n_hex, x.base_sha256) == brute.secrets(rows[x.doc_id])[:4] for x in got)


def test_redacted(spark):
    from tessellum.llm.secrets import redacted

    df = frame(spark, [(1, "x password: hunter22 y token=abc z"), (2, None), (None, "0123456789abcdef01234567 é")])
    assert {x.doc_id: x.text for x in redacted(df).collect()} == {1: "x [assign] y token=abc z", 2: None, None: "[hex] é"}
    assert redacted(df).columns == df.columns


def test_contained(spark):
    from tessellum.llm.decontaminate import pairs, without_items

    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(3, 30)))) for i in range(30)] + [(50, None), (51, ""), (None, "P q r s t u")]
    docs = []
    for d in range(150):
        w = " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 60))).split()
        if r.random() < 0.6:
            inner = (items[r.randrange(len(items))][1] or "").split()
            if inner and r.random() < 0.6:
                inner[r.randrange(len(inner))] = "zz"
            at = r.randint(0, len(w))
            w[at:at] = inner
        docs.append((d, "\n ".join(w).upper()))
    docs += [(200, None), (201, ""), (None, "p q R s t u"), (0, docs[0][1])]
    df, asked = frame(spark, docs), frame(spark, items, "item_id")
    want = brute.contained(docs, items)
    assert {tuple(x) for x in pairs(df, asked).collect()} == want and len(want) > 20
    hit = {x[0] for x in want}
    assert sorted(x.doc_id for x in without_items(df, asked).collect() if x.doc_id is not None) == sorted(d for d, _ in docs if d is not None and d not in hit)
    assert pairs(df, frame(spark, [], "item_id")).count() == pairs(frame(spark, []), asked).count() == 0


def test_contained_when_shuffled(spark, monkeypatch):
    from tessellum.llm import decontaminate, queries

    want = {tuple(x) for x in queries.op8_decontaminate(spark, SF).collect()}
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert {tuple(x) for x in queries.op8_decontaminate(spark, SF).collect()} == want and want
