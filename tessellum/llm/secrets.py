"""Secret scans by a trigram inverted index, in DataFrame operations only.

Each rule's regular expression gives a Boolean trigram query (``trigrams``). The index has a posting for
each trigram of the rules' dictionary and each text that contains it; postings are joined with the queries'
branches and intersected by counting, and only candidates are matched against the rule. Rules without a
mandatory trigram are matched against every text. Positions come from the pieces between matches, in code
points, by a running sum within the text.

Defined results: a null or empty text has no spans; repeated rows have equal results each; a null doc_id
stays null; an empty table gives no rows; a very long text is matched whole; other columns are ignored, and kept as they are
where texts are redacted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .batches import fresh
from .decontaminate import few
from .substring_dedup import id_of, keyed
from .trigrams import query


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: The group whose length counts (0: the whole match), and the least length.
    group: int = 0
    least: int = 1


# The base rules and their order.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
# Spans that this method adds: keys whose form alone tells them.
ADDED = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + ADDED


def index(texts: DataFrame, dictionary: list[str]) -> DataFrame:
    """Postings (trigram, did, th) of the dictionary's trigrams over the lower-cased texts."""
    low = texts.select("did", "th", F.lower("text").alias("low"))
    there = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in dictionary]))
    return low.select(F.explode(there).alias("trigram"), "did", "th")


def candidates(texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(did, th, kinds): the rules whose trigram queries hold."""
    branches = [
        (r.kind, len(q), c, b, len(grams), t)
        for r in rules
        if (q := query(r.pattern))
        for c, clause in enumerate(q)
        for b, grams in enumerate(clause)
        for t in sorted(grams)
    ]
    # as many rows as the rules have trigrams, made here: small enough to broadcast whatever the corpus
    asked = texts.sparkSession.createDataFrame(branches, "kind string, clauses int, clause int, branch int, size int, trigram string")
    postings = index(texts, sorted({x[5] for x in branches}))
    branch = postings.join(F.broadcast(asked), "trigram").groupBy("did", "th", "kind", "clauses", "clause", "branch", "size").agg(F.count_distinct("trigram").alias("n"))
    held = branch.where("n = size").groupBy("did", "th", "kind", "clauses").agg(F.count_distinct("clause").alias("n")).where("n = clauses")
    return held.groupBy("did", "th").agg(F.collect_set("kind").alias("kinds"))


def _pieces(rule: Rule, text: Column) -> Column:
    """Text between matches, matches, and the group that counts, side by side; the last piece has no match."""
    p = F.lit(rule.pattern)
    return F.arrays_zip(
        F.split(text, rule.pattern, -1).alias("gap"),
        F.regexp_extract_all(text, p, F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, p, F.lit(rule.group)).alias("value"),
    )


def spans(texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(did, th, kind, rank, start, end): code points, end exclusive; leftmost and without overlaps within a kind."""
    scan = {r.kind for r in rules if not query(r.pattern)}
    asked = F.coalesce("kinds", F.array().cast("array<string>"))
    looked = texts.join(few(candidates(texts, rules), "candidates"), ["did", "th"], "left").withColumn("kinds", asked)
    each = F.array(
        *[
            F.when(
                (F.lit(r.kind in scan) | F.array_contains("kinds", r.kind)) & F.col("text").rlike(r.pattern),
                F.struct(F.lit(r.kind).alias("kind"), F.lit(i).alias("rank"), F.lit(r.least).alias("least"), _pieces(r, F.col("text")).alias("pieces")),
            )
            for i, r in enumerate(rules)
        ]
    )
    found = looked.select("did", "th", F.explode(F.array_compact(each)).alias("r")).select("did", "th", "r.kind", "r.rank", "r.least", F.posexplode("r.pieces").alias("pos", "p"))
    found = found.where("p.hit IS NOT NULL").select("did", "th", "kind", "rank", "least", "pos", F.length("p.gap").alias("gap"), F.length("p.hit").alias("hit"), F.length("p.value").alias("value"))
    found = found.dropDuplicates(["did", "th", "rank", "pos"])  # equal rows have equal spans
    to_here = Window.partitionBy("did", "th", "kind", "rank").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    ends = found.withColumn("end", F.sum(F.col("gap") + F.col("hit")).over(to_here))
    return ends.where("value >= least").select("did", "th", "kind", "rank", (F.col("end") - F.col("hit")).alias("start"), "end")


def _joined(listed: Column) -> Column:
    return F.array_join(F.transform(listed, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")


def _put(rule: Rule) -> Column:
    """The text with the rule's secrets replaced."""

    def piece(x: Column) -> Column:
        return F.concat(x["gap"], F.when(x["hit"].isNull(), "").when(F.length(x["value"]) >= rule.least, f"[{rule.kind}]").otherwise(x["hit"]))

    return F.array_join(F.transform(_pieces(rule, F.col("text")), piece), "")


def scanned(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """doc_id, n_<kind> of the base rules, base_sha256, spans. The base rules must come first among the rules."""
    texts = keyed(docs)
    listed = spans(texts, rules).groupBy("did", "th").agg(F.sort_array(F.collect_list(F.struct("start", "rank", "end", "kind"))).alias("spans"))
    got = texts.select("did", "th").join(listed, ["did", "th"], "left")
    got = got.withColumn("spans", F.coalesce("spans", F.array().cast(listed.schema["spans"].dataType)))
    n = len(base)
    return got.select(
        id_of(),
        *[_count(r.kind).alias(f"n_{r.kind}") for r in base],
        F.sha2(_joined(F.filter("spans", lambda x: x["rank"] < n)), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents with each secret replaced by its kind in brackets; a text without secrets, or null, stays as it is."""
    names = docs.columns
    did, th, kinds = fresh(docs, "did", "th", "kinds")
    named = docs.withColumn(did, F.coalesce("doc_id", F.lit((1 << 63) - 1))).withColumn(th, F.xxhash64(F.coalesce("text", F.lit(""))))
    found = few(candidates(keyed(docs), rules).select(F.col("did").alias(did), F.col("th").alias(th), F.col("kinds").alias(kinds)), "candidates")
    out = named.join(found, [did, th], "left")
    for r in rules:
        may = F.lit(True) if not query(r.pattern) else F.coalesce(F.array_contains(kinds, r.kind), F.lit(False))
        out = out.withColumn("text", F.when(may & F.col("text").rlike(r.pattern), _put(r)).otherwise(F.col("text")))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*names)


def oracle(rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE) -> str:
    """``scanned`` in DuckDB SQL: every rule over every text, positions by running sums over what stands between matches."""

    def plain(pattern: str) -> str:
        """Letters in either case as classes, since other engines' case folding reaches beyond ASCII."""
        head, mark, rest = pattern.partition("(?i:")
        if not mark:
            return pattern
        words, _, rest = rest.partition(")")
        return head + "(?:" + "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words) + ")" + rest

    parts = []
    for i, r in enumerate(rules):
        q = plain(r.pattern).replace("'", "''")
        parts.append(
            f"SELECT doc_id, '{r.kind}' AS kind, {i} AS rank, {r.least} AS least, regexp_split_to_array(t, '{q}') AS g, "
            f"regexp_extract_all(t, '{q}') AS h, regexp_extract_all(t, '{q}', {r.group}) AS v FROM d WHERE regexp_matches(t, '{q}')"
        )
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in base)
    shown = "kind || ':' || a || ':' || e"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ({" UNION ALL ".join(parts)}),
x AS (SELECT doc_id, kind, rank, least, unnest(h) AS h, unnest(v) AS v, unnest(g[1:len(h)]) AS g, unnest(range(1, len(h) + 1)) AS i FROM m),
p AS (SELECT *, sum(length(g) + length(h)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop FROM x),
s AS (SELECT doc_id, kind, rank, CAST(stop - length(h) AS BIGINT) AS a, CAST(stop AS BIGINT) AS e FROM p WHERE length(v) >= least)
SELECT d.doc_id, {counts}, sha256(coalesce(string_agg({shown}, ',' ORDER BY a, rank) FILTER (rank < {len(base)}), '')) AS base_sha256,
  coalesce(string_agg({shown}, ',' ORDER BY a, rank), '') AS spans FROM d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id
""".strip()
