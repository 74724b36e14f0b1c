"""Greedy word-piece token counts by a linear longest-match automaton.

A word is a run of non-white-space characters. It is cut from the left into the longest vocabulary
entries: the first must begin with the word mark, the rest must not. The automaton is a trie with two
roots (word start, continuation). Each node holds a failure link to the continuation node that is left
when the pieces of the path so far are popped, and how many pieces that pops; so the count of a word
takes time linear in its length, and no piece is built. A word that cannot be cut counts as one unknown.

Cases: null and empty texts have no words; rows without an id are counted as others; very long words stay linear; equal texts get equal counts;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame

from tallyfold.llm.common import shipped, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Counts of so many words are remembered at most; longer words than MEMO_WORD never are.
MEMO_SIZE, MEMO_WORD = 400_000, 40


class Automaton:
    """``vocab``: entries; those that begin with ``mark`` start words."""

    def __init__(self, vocab: list[str], mark: str = MARK):
        self.mark = mark
        self.edges: list[dict[str, int]] = [{}, {}]
        token = [False, False]
        for entry in vocab:
            at = 0 if entry.startswith(mark) else 1
            for c in entry:
                nxt = self.edges[at].get(c)
                if nxt is None:
                    nxt = self.edges[at][c] = len(self.edges)
                    self.edges.append({})
                    token.append(False)
                at = nxt
            token[at] = True
        n = len(self.edges)
        self.fail: list[int] = [-1] * n
        self.popped = [0] * n
        queue = deque([0, 1])
        while queue:
            u = queue.popleft()
            for c, v in self.edges[u].items():
                if token[v]:
                    self.fail[v], self.popped[v] = 1, 1
                else:
                    z, pops = self.fail[u], self.popped[u]
                    while z >= 0 and c not in self.edges[z]:
                        pops += self.popped[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.popped[v] = self.edges[z][c], pops
                queue.append(v)

    def count(self, word: str) -> int:
        """Pieces of a word; 0 if it cannot be cut."""
        edges, fail, popped = self.edges, self.fail, self.popped
        at, n = 0, 0
        for c in self.mark + word:
            while (nxt := edges[at].get(c)) is None:
                n += popped[at]
                at = fail[at]
                if at < 0:
                    return 0
            at = nxt
        while at != 1:
            n += popped[at]
            at = fail[at]
            if at < 0:
                return 0
        return n


class Counts(dict):
    """Remembered counts of short words."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        n = self.automaton.count(word)
        if len(word) <= MEMO_WORD:
            if len(self) >= MEMO_SIZE:
                self.clear()
            self[word] = n
        return n


@functools.lru_cache(maxsize=2)
def counts(model: str) -> Counts:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    vocab = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    return Counts(Automaton([p for p in vocab if MARK not in p[1:]]))


def token_counts(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown): unknown words count as one token each."""

    local = shipped(docs.sparkSession, model)

    def run(batches):
        get = counts(local()).__getitem__
        for batch in slices(batches, 1):
            words, tokens, unknown = [], [], []
            for text in batch.column(1).to_pylist():
                found = list(map(get, text.split())) if text else []
                zero = found.count(0)
                words.append(len(found))
                tokens.append(sum(found) + zero)
                unknown.append(zero)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64()), pa.array(unknown, pa.int64())], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")
