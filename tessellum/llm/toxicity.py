"""Toxicity by Levenshtein automata over a lexicon trie, with context windows.

Lexicon. From a bounded sample of labelled texts: words, and stems that many words begin with, which
texts of the label have ``ODDS`` times as often as others, or more. Matching. The automata that accept all strings
within a term's edit budget are intersected with the trie of all terms; the product is made deterministic
as words are met, so a word costs a table step per letter and mostly dies after a few. Context. A hit
counts as quoted if quotation marks enclose it nearby, or a word of reporting or mention stands in the
window before it; else as abuse. Score. Logistic regression over abuse and quoted hits, fitted on the same
sample. A hit counts as much as its term is worth, by the log of how many times oftener toxic texts have it. A misspelled hit counts
as ``CREDIT`` of the exact one, so its weight doesn't depend on whether the sample has such a spelling; only
terms whose misspellings stand in clean texts of the sample get less (``credits``).

Limits: words of fewer than 5 letters and stems of fewer than 6 must stand unchanged.

Labels are used from at most ``most_labels`` texts of each label, those of least hash of the doc_id, and never
from the held-out fold. Copies in the sample count once (``unlike``). Defined results: a null or empty text has no hits and is scored so; if a label has
no row in the sample, every score is 0; repeated rows are scored each; a null doc_id isn't held out;
an empty table gives no rows; very long texts are scanned whole; other columns are ignored or kept as they are.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import begun, bounded_batches, map_batches, pieces, texts_of
from .quality_rank import in_fold, sample_of

MOST_LABELS = 3000
#: How many times oftener a term must stand in toxic texts than in clean ones, its least number of toxic texts, and that number's least share of them.
ODDS, SUPPORT, SHARE = 15.0, 3, 0.01
STEM_SIZES = (4, 5, 6, 7, 8)
#: That ratio for a term of full worth; and occurrences in one text beyond this number don't count for it.
SURE, MOST_IN_TEXT = 1000.0, 4
#: What a misspelled hit counts, of an exact one, and how many texts that belief is worth against counted ones.
CREDIT, BELIEF = 0.9, 2.0
TOKEN = re.compile(r"[^\W_]+(?:[@$*0-9]+[^\W_]+)*")
QUOTES = {'"': '"', "“": "”", "«": "»", "„": "“", "‘": "’", "”": "”", "»": "«"}
# Words of reporting or mention, in the corpus's languages.
MENTION = frozenset(
    "said says say quote quoted quotes called calls wrote writes term word words slur phrase insult reported alleged "
    "dit disait cite mot terme appelle sagte sagt schrieb zitiert wort begriff dijo dice cita palabra término llamó".split()
)
REACH, BEFORE, DENSE = 60, 6, 200


def budget(term: str) -> int:
    """Edits allowed in a whole word of that length."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


def stem_budget(stem: str) -> int:
    """Edits allowed in a stem, which any ending may follow, so fewer than in a word."""
    return 0 if len(stem) < 6 else 1


class _Node:
    __slots__ = ("next", "term", "stem", "most")

    def __init__(self):
        self.next: dict[str, _Node] = {}
        self.term = self.stem = None
        self.most = 0


class _State(dict):
    """Nodes of the trie with the edits spent to get there; maps a letter to the next state, made when first asked for."""

    __slots__ = ("nodes", "found", "machine", "stem")

    def __missing__(self, letter: str) -> _State:
        least: dict[_Node, int] = {}

        def put(node: _Node, spent: int) -> None:
            if spent <= node.most and spent < least.get(node, 9):
                least[node] = spent
                for child in node.next.values():
                    put(child, spent + 1)  # a letter left out

        for node, spent in self.nodes:
            put(node, spent + 1)  # a letter too many
            for x, child in node.next.items():
                put(child, spent if x == letter else spent + 1)
        got = self[letter] = self.machine.state(least)
        return got


class Lexicon:
    """Terms matched as whole words, and stems matched at a word's beginning, both within their budgets."""

    def __init__(self, terms: list[str], stems: list[str], innocent: frozenset[str] = frozenset(), worth: list[float] | None = None, credit: list[float] | None = None, keep: int = 250_000, keep_states: int = 60_000):
        self.terms, self.innocent, self.keep, self.keep_states = [*terms, *stems], innocent, keep, keep_states
        self.worth, self.credit = (x or [1.0] * len(self.terms) for x in (worth, credit))
        self.root = _Node()
        for i, (word, stem) in enumerate([*((t, False) for t in terms), *((s, True) for s in stems)]):
            node, most = self.root, (stem_budget if stem else budget)(word)
            node.most = max(node.most, most)
            for x in word:
                node = node.next.setdefault(x, _Node())
                node.most = max(node.most, most)
            if stem:
                node.stem = i
            else:
                node.term = i
        self.known: dict[str, tuple[int, int] | None] = _Known(self)
        self._empty()

    def _empty(self) -> None:
        self.states: dict[frozenset, _State] = {}
        start: dict[_Node, int] = {}

        def put(node: _Node, spent: int) -> None:
            if spent <= node.most and spent < start.get(node, 9):
                start[node] = spent
                for child in node.next.values():
                    put(child, spent + 1)

        put(self.root, 0)
        self.start = self.state(start)

    def release(self) -> None:
        """Let go of all states, which refer to each other, so that their memory is free at once."""
        for state in self.states.values():
            state.clear()
        self.states.clear()
        self.known.clear()
        self.start = None

    def state(self, least: dict[_Node, int]) -> _State:
        key = frozenset(least.items())
        got = self.states.get(key)
        if got is None:
            got = self.states[key] = _State()
            got.nodes, got.machine = tuple(least.items()), self
            ends = [(spent, node.term) for node, spent in least.items() if node.term is not None and spent <= budget(self.terms[node.term])]
            got.found = min(ends, default=None)
            starts = [(spent, node.stem) for node, spent in least.items() if node.stem is not None and spent <= stem_budget(self.terms[node.stem])]
            got.stem = min(starts, default=None)
        return got

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, index of the term) of the nearest term, or None; innocent words match nothing."""
        if word in self.innocent:
            return None
        if len(self.states) > self.keep_states:
            self._empty()
        state, best = self.start, None
        for letter in word:
            state = state[letter]
            if state.stem is not None and (best is None or state.stem < best):
                best = state.stem
                if not best[0]:
                    return best
            if not state.nodes:
                return best
        return best if state.found is None else state.found if best is None else min(best, state.found)


class _Known(dict):
    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon

    def __missing__(self, word: str):
        if len(self) >= self.lexicon.keep:
            self.clear()
        got = self[word] = self.lexicon.match(word)
        return got


def quoted(text: str, start: int, end: int) -> bool:
    """Whether quotation marks enclose the hit within reach, or a word of mention stands before it."""
    before, after = text[max(0, start - REACH) : start], text[end : end + REACH]
    cut = max(before.rfind("\n"), *(before.rfind(x) for x in ".!?"))
    near = before[cut + 1 :]
    for opening, closing in QUOTES.items():
        at = near.rfind(opening)
        if at >= 0 and closing in after and (opening != closing or near.count(opening) % 2):
            return True
    return not MENTION.isdisjoint(x.lower() for x in TOKEN.findall(near)[-BEFORE:])


def features(lexicon: Lexicon, text: str) -> list[float]:
    """1; greatest and log of the summed value of abuse, of quoted hits, of misspelled abuse, of misspelled quoted hits.

    In texts of more than DENSE words the sum is that of an average stretch of DENSE words, since long texts meet more terms by chance.
    """
    low = text.lower()
    known = lexicon.known
    words = TOKEN.findall(low)
    if not any(map(known.__getitem__, words)):
        return [1.0, *[0.0] * 8]
    stretches = max(1.0, len(words) / DENSE)
    best, total = [0.0] * 4, [0.0] * 4
    for m in TOKEN.finditer(low):
        hit = known[m[0]]
        if hit:
            edits, term = hit
            k, value = 2 * (edits > 0) + quoted(low, m.start(), m.end()), lexicon.worth[term] * (lexicon.credit[term] if edits else 1.0)
            best[k] = max(best[k], value)
            total[k] += value
    return [1.0, *(x for b, t in zip(best, total, strict=True) for x in (b, min(2.0, math.log1p(t / stretches))))]


def unlike(texts: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """The sample without copies, so that a text that stands in it many times teaches no more than once.

    A text goes if an earlier one of its label has the same four longer words of least checksum, or the same four of least
    checksum read backwards; both sketches of one-word changes rarely fail at once, and unlike texts rarely share four.
    Texts with fewer than eight longer words go only if they have the same set of words.
    """
    seen, out = set(), []
    for t, y in texts:
        words = set(TOKEN.findall(t.lower()))
        long_ = [w for w in words if len(w) > 4]
        if len(long_) < 8:
            keys = [(y, frozenset(words))]
        else:
            keys = [(y, k, *sorted(crc32(w[::k].encode()) for w in long_)[:4]) for k in (1, -1)]
        if seen.isdisjoint(keys):
            out.append((t, y))
        seen.update(keys)
    return out


def learn_terms(texts: list[tuple[str, int]]) -> tuple[list[str], list[str], list[float]]:
    """Words and stems that mark the texts of label 1, beyond what chance gives among so many candidates, and what each is worth."""

    def parts(text: str) -> Counter:
        found: Counter = Counter()
        for w, n in Counter(TOKEN.findall(text.lower())).items():
            found[w] += n
            for k in STEM_SIZES:
                if len(w) > k:
                    found[w[:k] + "-"] += n
        return found

    toxic = [parts(t) for t, y in texts if y]
    clean = [t for t, y in texts if not y]
    if not toxic or not clean:
        return [], [], []
    hits: Counter = Counter()  # texts
    for p in toxic:
        hits.update(p.keys())
    hits = Counter({k: v for k, v in hits.items() if v >= max(SUPPORT, SHARE * len(toxic))})
    often, misses, seldom = Counter(), Counter(), Counter()  # occurrences, and both for clean texts
    for p in toxic:
        often.update({k: min(n, MOST_IN_TEXT) for k, n in p.items() if k in hits})
    for t in clean:
        p = parts(t)
        both = hits.keys() & p.keys()
        misses.update(both)
        seldom.update({k: min(p[k], MOST_IN_TEXT) for k in both})
    base = len(toxic) / len(texts)
    chance = math.log(10 * max(1, len(hits)))

    def odds(k: str) -> float:
        return (often[k] + 0.5) / len(toxic) / ((seldom[k] + 0.5) / len(clean))

    def marks(k: str) -> bool:
        v, m = hits[k], misses[k]
        share = v / (v + m)
        gain = share * math.log(share / base) + (1 - share) * math.log(max(1e-9, 1 - share) / (1 - base))
        return odds(k) >= ODDS and (v + m) * gain >= chance

    good = {k for k in hits if marks(k)}
    stems: list[str] = []
    for k in sorted((x for x in good if x[-1] == "-"), key=len):
        if any(k.startswith(s) for s in stems):
            continue
        longer = [x for x in good if x[-1] == "-" and len(x) > len(k) and x.startswith(k[:-1]) and hits[x] >= 0.95 * hits[k]]
        whole = max((hits[w] for w in hits if w[-1] != "-" and w.startswith(k[:-1])), default=0)
        if whole < 0.8 * hits[k]:  # else it is one word, and the word is the term
            stems.append(max(longer, key=len, default=k)[:-1])
    stems = sorted(set(stems))
    words = sorted(w for w in good if w[-1] != "-" and not any(w.startswith(s) for s in stems))
    return words, stems, [min(1.0, math.log(odds(k)) / math.log(SURE)) for k in (*words, *(s + "-" for s in stems))]


def innocent(lexicon: Lexicon, texts: list[str]) -> frozenset[str]:
    """Words of clean texts that only resemble a term."""
    return frozenset(w for t in texts for w in set(TOKEN.findall(t.lower())) if (hit := lexicon.known[w]) and hit[0])


def fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        grad = x.T @ (p - y) / len(y) + ridge * w
        hess = (x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def credits(lexicon: Lexicon, texts: list[tuple[str, int]]) -> list[float]:
    """For each term, how much more often its misspellings stand in toxic texts than in clean ones, smoothed towards 1."""
    share = [max(1, sum(y == label for _, y in texts)) for label in (0, 1)]
    seen = [Counter(), Counter()]
    for t, y in texts:
        seen[y].update({hit[1] for w in set(TOKEN.findall(t.lower())) if (hit := lexicon.known[w]) and hit[0]})
    clean = [seen[0][i] * share[1] / share[0] for i in range(len(lexicon.terms))]
    return [(BELIEF + seen[1][i]) / (BELIEF + seen[1][i] + c * share[0] / share[1] / 2 + c) for i, c in enumerate(clean)]


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", folds: int = 3, fold: int = 1, most_labels: int = MOST_LABELS) -> tuple[tuple, np.ndarray] | None:
    rows = sample_of(docs, labels, label, folds, fold, most_labels).collect()
    rows.sort(key=lambda r: (crc32(str(r.doc_id).encode()), r.doc_id or 0, r.text))
    return learn([(r.text, r.y) for r in rows])


def learn(texts: list[tuple[str, int]]) -> tuple[tuple, np.ndarray] | None:
    """(what the lexicon is made of, weights); innocent words come from one half of the clean texts, credits and weights from the rest."""
    texts = unlike(texts)
    if {y for _, y in texts} != {0, 1}:
        return None
    words, stems, worth = learn_terms(texts)
    clean = [t for t, y in texts if not y]
    spared = frozenset(clean[::2])
    spare = innocent(Lexicon(words, stems), clean[::2])
    rest = [(t, y) for t, y in texts if y or t not in spared]
    made_of = (words, stems, spare, worth, credits(Lexicon(words, stems, spare), rest))
    lexicon = Lexicon(*made_of)
    x, y = np.array([features(lexicon, t) for t, _ in rest]), np.array([float(y) for _, y in rest])
    return made_of, fit_weights(tied(x), y)


def tied(x: np.ndarray) -> np.ndarray:
    """``features`` with misspelled hits as CREDIT of exact ones: 1; greatest and log of the summed value of abuse, and of quoted hits."""
    greatest = np.maximum(x[:, [1, 3]], CREDIT * x[:, [5, 7]])
    summed = np.log1p(np.expm1(x[:, [2, 4]]) + CREDIT * np.expm1(x[:, [6, 8]]))
    return np.column_stack([x[:, 0], greatest[:, 0], summed[:, 0], greatest[:, 1], summed[:, 1]])


def scored(docs: DataFrame, labels: DataFrame, *, folds: int = 3, fold: int = 1, threshold: float = 0.7, most_labels: int = MOST_LABELS) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold)."""
    model = fit(docs, labels, folds=folds, fold=fold, most_labels=most_labels)
    got = map_batches(texts_of(docs), lambda: _scorer(model), "doc_id long, score double")
    return got.select("doc_id", in_fold(F.col("doc_id"), folds, fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, *, folds: int = 3, fold: int = 1, threshold: float = 0.7, most_labels: int = MOST_LABELS) -> DataFrame:
    """The documents, all columns as they are, whose score is below the threshold."""
    bounded_batches(docs.sparkSession)
    model = fit(docs, labels, folds=folds, fold=fold, most_labels=most_labels)

    def run(batches):
        step = begun(lambda: _scorer(model))
        try:
            for batch in pieces(batches):
                text = pc.fill_null(batch.column("text"), "")
                score = step(pa.RecordBatch.from_arrays([text, text], names=["doc_id", "text"]))["score"]
                yield batch.filter(pa.array(np.asarray(score) < threshold))
        finally:
            getattr(step, "close", lambda: None)()

    return docs.mapInArrow(run, docs.schema)


def _scorer(model):
    if model is None:
        return lambda batch: {"doc_id": batch.column("doc_id"), "score": [0.0] * batch.num_rows}
    lexicon, w = Lexicon(*model[0]), model[1]

    def step(batch):
        x = np.array([features(lexicon, t) for t in batch.column("text").to_pylist()]).reshape(-1, 9)
        return {"doc_id": batch.column("doc_id"), "score": 1 / (1 + np.exp(-np.clip(tied(x) @ w, -40, 40)))}

    step.close = lexicon.release
    return step
