"""Token counts by a linear longest-match automaton.

The vocabulary becomes a trie. Each node has a failure link and the number of tokens popped when it is followed, both computed
once, so a word is cut greedily into its longest pieces in one pass over its characters, and only the number of pieces is kept:
no piece is built and no character is read twice.

Words come from the vocabulary file's own rules: NFC, lower case, its word pattern, bytes written as printable characters, and
an end-of-word mark as a last symbol. A word that cannot be cut is one (unknown) token.

Scale: map-only, one pass over the text. The driver reads the vocabulary file, whose path is a parameter, and broadcasts its tokens
(at most ``MAX_TOKENS``); executors need no such file. Each Python worker builds the automaton once and remembers the counts of words
in a table of bounded size.

Defined cases: a null or empty text has 0 words and 0 tokens; a word of any length costs time in proportion; repeated rows are
counted each; a null doc_id stays null. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onomast.llm.textbuf import small_batches

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
END_MARK = "</w>"
REMEMBERED = 500_000
MAX_TOKENS = 1 << 20


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else the next from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    fresh = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(fresh)) for b in range(256)]


class LongestMatch:
    """The automaton. Nodes are integers, 0 the root; ``step[node]`` maps a symbol to a node."""

    def __init__(self, vocabulary: Iterable[tuple[str, ...]]) -> None:
        self.step: list[dict[str, int]] = [{}]
        is_token = [False]
        for token in vocabulary:
            node = 0
            for symbol in token:
                nxt = self.step[node].get(symbol)
                if nxt is None:
                    nxt = self.step[node][symbol] = len(self.step)
                    self.step.append({})
                    is_token.append(False)
                node = nxt
            is_token[node] = node != 0
        self.fail: list[int | None] = [None] * len(self.step)
        self.popped = [0] * len(self.step)
        level = [0]
        while level:
            below = []
            for u in level:
                for symbol, v in self.step[u].items():
                    below.append(v)
                    if is_token[v]:
                        self.fail[v], self.popped[v] = 0, 1
                        continue
                    z, n = self.fail[u], self.popped[u]
                    while z is not None and symbol not in self.step[z]:
                        z, n = self.fail[z], n + self.popped[z]
                    if z is not None:
                        self.fail[v], self.popped[v] = self.step[z][symbol], n
            level = below

    def pieces(self, word: Iterable[str]) -> int:
        """The number of greedy longest pieces of ``word``; 1 if it cannot be cut, 0 if it is empty."""
        u, n = 0, 0
        for symbol in word:
            while (v := self.step[u].get(symbol)) is None:
                if (f := self.fail[u]) is None:
                    return 1
                n, u = n + self.popped[u], f
            u = v
        while u:
            if (f := self.fail[u]) is None:
                return 1
            n, u = n + self.popped[u], f
        return n


def load_vocabulary(path: str) -> list[tuple[str, ...]]:
    """Tokens as symbol sequences, the end-of-word mark being one symbol."""
    with open(path, encoding="utf-8") as f:
        tokens = json.load(f)["model"]["vocab"]
    return [(*t.removesuffix(END_MARK), END_MARK) if t.endswith(END_MARK) else tuple(t) for t in tokens]


class Counter(dict):
    """word -> number of tokens, computed on first use; emptied when full."""

    def __init__(self, automaton: LongestMatch) -> None:
        super().__init__()
        self.automaton, self.alphabet = automaton, byte_alphabet()

    def __missing__(self, word: str) -> int:
        n = self.automaton.pieces([*(self.alphabet[b] for b in word.encode()), END_MARK])
        if len(word) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = n
        return n

    def count(self, text: str | None) -> tuple[int, int]:
        words = WORD.findall(unicodedata.normalize("NFC", text).lower()) if text else []
        return len(words), sum(map(self.__getitem__, words))


_counters: dict[str, Counter] = {}


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_words, n_tokens for every document."""
    small_batches(docs.sparkSession)
    tokens = load_vocabulary(vocabulary)
    if len(tokens) > MAX_TOKENS:
        raise ValueError(f"{vocabulary} holds {len(tokens)} tokens; at most {MAX_TOKENS} are broadcast")
    named = hashlib.sha256(repr(tokens).encode()).hexdigest()
    sent = docs.sparkSession.sparkContext.broadcast(tokens)

    @F.pandas_udf("n_words long, n_tokens long")
    def count(texts: pd.Series) -> pd.DataFrame:
        if named not in _counters:
            _counters[named] = Counter(LongestMatch(sent.value))
        c = _counters[named]
        return pd.DataFrame([c.count(t) for t in texts], columns=["n_words", "n_tokens"], dtype="int64")

    return docs.select("doc_id", count("text").alias("n")).select("doc_id", "n.n_words", "n.n_tokens")
