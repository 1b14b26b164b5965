"""Token counts by prefix dynamic programming.

For each pretoken the table holds, at every prefix, the last token of that prefix's encoding and
the number of tokens. Both follow from shorter prefixes (see ``bpe.PairTest``), so the counts of all
prefixes cost one pass. A text's table (``prefix_table``) holds the change of the count at every
character; counts, truncation points and budgets are read off it (``budgets``) without encoding again.

Characters are those of the normalised text: composed, lower case, special strings as they stand. Inside a
special string the prefix ends in ordinary characters, and is counted so.

Defined results: a null or empty text has 0 tokens; texts of white space only have 0; repeated rows
are counted each; a null ``doc_id`` stays null; an empty table gives no rows; a very long text takes four bytes a
character while it is counted; other columns are ignored.
"""

from __future__ import annotations

import gc
import json
import unicodedata
from array import array
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .batches import kept, map_batches, texts_of
from .bpe import PairTest

END = "</w>"
#: White space as the vocabulary's pattern has it; ``str.lstrip`` alone would take U+001C to U+001F too, which are pretokens.
SPACE = "".join(regex.findall(r"\p{White_Space}", "".join(map(chr, range(0x3001)))))


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable bytes as they are, the rest from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256))
    return [chr(b) if b in plain else chr(256 + next(rest)) for b in range(256)]


class _State(dict):
    """The next state by each byte met. A state is the longest end of the bytes read that begins a token; ``inner`` and
    ``final`` are the tokens that end there, longest first."""

    __slots__ = ("counter", "final", "inner", "read")

    def __init__(self, counter: PrefixCounter, read: str):
        self.counter, self.read = counter, read
        ends = [read[k:] for k in range(len(read))]
        self.inner = [(len(t), counter.after(t)) for t in ends if t in counter.inner]
        self.final = [(len(t), counter.after(t + END)) for t in ends if t in counter.final]

    def __missing__(self, byte: int) -> _State:
        self.counter.room()
        got = self[byte] = self.counter.state(self.read + self.counter.bytes[byte])
        return got


class _After(dict):
    """Whether one token may stand after each of those met before it (``bpe.PairTest``)."""

    __slots__ = ("counter", "token")

    def __init__(self, counter: PrefixCounter, token: str):
        self.counter, self.token = counter, token

    def __missing__(self, left: str | None) -> bool:
        self.counter.room()
        got = self[left] = self.counter.stands._test(left, self.token)
        return got


class PrefixCounter:
    """Prefix counts for a tokenizer file of the kind BPE with word ends (lower case, white space dropped)."""

    def __init__(self, path: str, keep: int = 500_000):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != END:
            raise ValueError(f"{path} isn't a BPE vocabulary with {END}")
        ranks = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        vocab = model["vocab"]
        self.inner = {t for t in vocab if not t.endswith(END)}
        self.final = {t.removesuffix(END) for t in vocab if t.endswith(END)}
        self.begins = {t[:k] for t in self.inner | self.final for k in range(len(t) + 1)}
        self.bytes = byte_alphabet()
        if not (self.inner.issuperset(self.bytes) and self.final.issuperset(self.bytes)):
            raise ValueError(f"{path} lacks tokens of single bytes")
        self.stands = PairTest(self._units, lambda a, b: ranks.get((a, b)))
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}"))
        self.spaced = regex.compile(rf"\p{{White_Space}}*+(?:{self.pieces.pattern})")
        self.keep = keep
        self.known: dict[str, bytes] = _Missing(self)
        self.states: dict[str, _State] = {}
        self.afters: dict[str, _After] = {}
        self.forget()

    @staticmethod
    def _units(token: str) -> list[str]:
        if token.endswith(END):
            body = token[: -len(END)]
            return [*body[:-1], body[-1] + END]
        return [*token]

    def normal(self, text: str) -> str:
        """NFC and lower case, character by character (a sigma at a word's end stays a common sigma)."""
        if text.isascii():
            return text.lower()
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def forget(self) -> None:
        """Begin the tables of states and pairs anew; emptied in place, since a pretoken may be under way."""
        for met in (*self.states.values(), *self.afters.values()):
            met.clear()
        self.states, self.afters, self.met = {}, {}, 0
        self.start = self.state("")

    def room(self) -> None:
        if self.met >= self.keep:
            self.forget()
        self.met += 1

    def after(self, token: str) -> _After:
        got = self.afters.get(token)
        if got is None:
            got = self.afters[token] = _After(self, token)
        return got

    def state(self, read: str) -> _State:
        while read not in self.begins:
            read = read[1:]
        got = self.states.get(read)
        if got is None:
            got = self.states[read] = _State(self, read)
        return got

    def table(self, piece: str) -> list[int]:
        """Change of the count at each character of one pretoken.

        At each byte: the last token and the count if more follow, and the count as a whole word if a character ends there.
        """
        raw = piece.encode()
        plain, end = len(raw) == len(piece), len(raw)
        state, lasts, counts, out, before, i = self.start, [None], [0], [], 0, 0
        for byte in raw:
            state = state[byte]
            i += 1
            for size, after in state.inner:
                if after[lasts[i - size]]:
                    lasts.append(after.token)
                    counts.append(counts[i - size] + 1)
                    break
            if plain or i == end or raw[i] & 0xC0 != 0x80:
                for size, after in state.final:
                    if after[lasts[i - size]]:
                        n = counts[i - size] + 1
                        out.append(n - before)
                        before = n
                        break
        return out

    def of_piece(self, piece: str) -> int:
        return sum(self.table(piece))

    def piece_steps(self, piece: str) -> list[int]:
        """``table``, but for pretokens whose prefixes are split otherwise than the whole: contractions, of three characters at most.
        A longer run of punctuation that begins with an apostrophe has runs of punctuation as prefixes."""
        if piece[0] == "'" and 1 < len(piece) <= 3:
            counts = [0, *(sum(self.of_piece(x) for x in self.pieces.findall(piece[:k])) for k in range(1, len(piece) + 1))]
            return [b - a for a, b in pairwise(counts)]
        return self.table(piece)

    def _plain(self, text: str) -> np.ndarray:
        """Changes of the count at each character of a normalised text without special strings."""
        found = self.spaced.findall(text)
        steps = np.frombuffer(b"".join(map(self.known.__getitem__, found)), np.int32)
        rest = len(text) - len(steps)
        return np.concatenate([steps, np.zeros(rest, np.int32)]) if rest else steps

    def steps(self, text: str) -> np.ndarray:
        """Entry i: by how much character i of the normalised text changes the count."""
        if "<|" not in text:
            return self._plain(self.normal(text))
        parts, at = [], 0
        for m in self.special.finditer(text):
            before = self.normal(text[at : m.start()])
            ahead = self._plain(before + m[0][:-1])
            parts += [ahead, np.array([self._plain(before).sum() + 1 - ahead.sum()], np.int32)]
            at = m.end()
        return np.concatenate([*parts, self._plain(self.normal(text[at:]))])

    def release(self) -> None:
        self.known.clear()
        self.known.older = {}
        self.forget()

    def count(self, text: str) -> int:
        return int(self.steps(text).sum())

    def prefix_counts(self, text: str) -> list[int]:
        """Entry i: tokens of the first i characters of the normalised text."""
        return [0, *np.cumsum(self.steps(text)).tolist()]

    def fits(self, text: str, budget: int) -> int:
        return fit(self.steps(text), budget)


def fit(steps: np.ndarray, budget: int) -> int:
    """The most characters for which that prefix and all shorter ones have at most ``budget`` tokens."""
    if not len(steps):
        return 0
    return int(np.searchsorted(np.maximum.accumulate(np.cumsum(steps)), budget, "right"))


class _Missing(dict):
    """Tables of pretokens met lately, with the white space before them: when the table is full it becomes the older half, whose entries return when used."""

    def __init__(self, counter: PrefixCounter):
        self.counter, self.older = counter, {}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.counter.keep:
            self.older = dict(self)
            self.clear()
        got = self.older.get(piece)
        if got is None:
            bare = piece.lstrip(SPACE)
            got = array("i", [0] * (len(piece) - len(bare)) + self.counter.piece_steps(bare)).tobytes()
        self[piece] = got
        return got


def counter(path: str) -> PrefixCounter:
    """One per worker process: its tables serve all the tasks there. The vocabulary stays, so the collector needn't look at it again."""

    def build() -> PrefixCounter:
        got = PrefixCounter(path)
        gc.freeze()
        return got

    return kept(f"token_counts {path}", build)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and n_chars_fit (``fit`` for the limit) of every whole text, read off its
    table of prefixes where that is made; a map without a shuffle."""

    def make():
        c = counter(vocabulary)

        def step(batch):
            texts = batch.column("text").to_pylist()
            n, chars = [], []
            for x in texts:
                steps = c.steps(x)
                n.append(int(steps.sum()))
                chars.append(fit(steps, limit))
            return {"doc_id": batch.column("doc_id"), "n_bytes": [len(x.encode()) for x in texts], "n_tokens": n, "over_limit": [k > limit for k in n], "n_chars_fit": chars}

        return step

    return map_batches(texts_of(docs), make, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_chars_fit long")


def prefix_table(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, steps: the change of the count at every character, to be stored and asked later."""

    def make():
        c = counter(vocabulary)

        def step(batch):
            texts = batch.column("text").to_pylist()
            steps = [c.steps(x) for x in texts]
            return {"doc_id": batch.column("doc_id"), "n_bytes": [len(x.encode()) for x in texts], "n_tokens": [int(x.sum()) for x in steps], "steps": steps}

        return step

    return map_batches(texts_of(docs), make, "doc_id long, n_bytes long, n_tokens long, steps array<int>")


def budgets(table: DataFrame, limits: list[int]) -> DataFrame:
    """doc_id, budget, n_chars_fit, cut for each row of a stored ``prefix_table`` and each limit; cut: whether the text is longer than that."""

    def make():
        def step(batch):
            rows, n, chars, cut = [], [], [], []
            for i, listed in enumerate(batch.column("steps")):
                steps = np.asarray(listed.values, np.int32)
                for limit in limits:
                    rows.append(i)
                    n.append(limit)
                    chars.append(fit(steps, limit))
                    cut.append(chars[-1] < len(steps))
            return {"doc_id": batch.column("doc_id").take(pa.array(rows)), "budget": n, "n_chars_fit": chars, "cut": cut}

        return step

    return map_batches(table.select("doc_id", "steps"), make, "doc_id long, budget long, n_chars_fit long, cut boolean")


def within_budget(docs: DataFrame, vocabulary: str, budget: int) -> DataFrame:
    """doc_id, n_chars_fit: how much of the normalised text stays within ``budget`` tokens."""
    return budgets(prefix_table(docs, vocabulary), [budget]).select("doc_id", "n_chars_fit")
