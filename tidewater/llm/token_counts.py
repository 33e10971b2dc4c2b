"""Greedy word-piece token counts by a linear longest-match automaton.

The vocabulary is a trie.  Where no edge goes on, a failure link leads to the node
from which matching goes on, and a count with it tells how many pieces are
complete on the way; so every character costs a step or an amortised failure, and
the number of pieces comes out without any piece being built.

Pieces are those of a SentencePiece model: those with the word mark start a word,
the others continue it.  A word is a run without the six ASCII white-space
characters; the word mark alone may be the first piece.  A word that can't be
covered counts as one unknown token.

Defined results: null and empty texts have 0 words and 0 tokens; doc_id is passed
through, also null; repeated rows are counted one by one; an empty table gives an
empty result.  Counts met are kept per worker, up to a bound, as words repeat.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewater.llm.shared import pick, table

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
#: Words kept in a worker at most; the cache then starts anew.
CACHE = 1_000_000
UNKNOWN = 1 << 40


class LongestMatch:
    """The automaton: two roots, one for a word's first piece and one for the pieces after it."""

    def __init__(self, first: Iterable[str], later: Iterable[str]):
        self.edges: list[dict[str, int]] = [{}, {}]
        self.piece = [False, False]
        order: list[tuple[int, int, str]] = []
        for root, pieces in ((0, first), (1, later)):
            for piece in pieces:
                node = root
                for c in piece:
                    if c not in self.edges[node]:
                        self.edges[node][c] = len(self.edges)
                        self.edges.append({})
                        self.piece.append(False)
                    node = self.edges[node][c]
                self.piece[node] = node > 1
        layer = [0, 1]
        while layer:
            step = [(n, child, c) for n in layer for c, child in self.edges[n].items()]
            order += step
            layer = [child for _, child, _ in step]
        self.fail = [-1] * len(self.edges)
        self.pops = [0] * len(self.edges)
        for parent, node, c in order:
            if self.piece[node]:
                self.fail[node], self.pops[node] = 1, 1
                continue
            at, pops = self.fail[parent], self.pops[parent]
            while at >= 0 and c not in self.edges[at]:
                pops += self.pops[at]
                at = self.fail[at]
            if at >= 0:
                self.fail[node], self.pops[node] = self.edges[at][c], pops

    def count(self, word: str) -> int | None:
        """Pieces of the greedy cover of a word, or None if there is none."""
        edges, fail, pops = self.edges, self.fail, self.pops
        node = n = 0
        for c in word:
            while (to := edges[node].get(c)) is None:
                n += pops[node]
                node = fail[node]
                if node < 0:
                    return None
            node = to
        while node > 1:
            n += pops[node]
            node = fail[node]
        return n if node == 1 else None


def load(path: str) -> LongestMatch:
    """The automaton of a SentencePiece model's own pieces: no control, byte or unknown pieces."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))]
    pieces = [model.id_to_piece(i) for i in ids]
    return LongestMatch([p for p in pieces if p.startswith(MARK)], [p for p in pieces if MARK not in p])


class Counter:
    """Counts of whole texts, with the words met so far."""

    def __init__(self, automaton: LongestMatch):
        self.automaton = automaton
        self.known: dict[str, int] = {}

    def texts(self, texts: list[str]) -> np.ndarray:
        """For each text its words, tokens and unknown words."""
        if len(self.known) > CACHE:
            self.known = {}
        known, count = self.known, self.automaton.count
        out = np.zeros((len(texts), 3), np.int64)
        for k, text in enumerate(texts):
            for c in SPACES:
                text = text.replace(c, " ")
            words = text.split(" ")
            for word in set(words).difference(known):
                n = count(MARK + word) if word else 0
                known[word] = 1 + UNKNOWN if n is None else n
            if len(words) > 1:
                found = sum(itemgetter(*words)(known))
            else:
                found = known[words[0]]
            out[k] = len(words) - words.count(""), found % UNKNOWN, found // UNKNOWN
        return out


#: The other white-space characters become a space.
SPACES = "\t\n\x0b\f\r"

_COUNTERS: dict[str, Counter] = {}


def counter_for(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(load(path))
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown) of every text."""
    df = pick(docs, "doc_id", "text")
    kind = df.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        counter = counter_for(public_tokenizers.path(vocabulary))
        for batch in batches:
            found = counter.texts([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[:, k].copy()) for k in range(3))], names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    return df.mapInArrow(run, f"doc_id {kind}, n_words long, n_tokens long, n_unknown long")


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
