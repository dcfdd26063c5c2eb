"""Unigram token counts: forward scores over a trie of the distinct pre-tokens."""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
#: Marks a word's beginning, as in the vocabulary.
MARK = "▁"
#: Nodes of a task's trie, and distinct pre-tokens that it remembers the counts of, before either starts over.
NODES_KEPT, WORDS_KEPT = 1_000_000, 500_000
_MODELS: dict[str, "Vocabulary"] = {}


class Vocabulary:
    """Pieces and their log scores. The file's pieces stand in order of use: the score is -log(rank + 1), so that a
    segmentation with few and frequent pieces wins. A character outside it costs its bytes, each at the lowest score."""

    def __init__(self, pieces: list[str]):
        self.score = {p: -math.log(k + 1) for k, p in enumerate(pieces) if p}
        self.longest = max(map(len, self.score), default=1)
        self.byte = -math.log(len(pieces) + 2) - 1.0

    @staticmethod
    def read(path: str) -> "Vocabulary":
        if path not in _MODELS:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            plain = [k for k in range(model.get_piece_size()) if not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k))]
            _MODELS[path] = Vocabulary([model.id_to_piece(k) for k in plain])
        return _MODELS[path]


class Trie:
    """Distinct pre-tokens, one node for each prefix that some of them share.

    A node holds the forward score of its prefix, the best sum of piece scores that spell it, with the pieces of that
    segmentation; both are computed once, when the node is made, from the nodes above it. The node at which a pre-token
    ends holds its count. Of equal scores the segmentation with fewer pieces wins.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.child: dict[int, int] = {}  # a node's number and a code point to the node below
        self.best, self.pieces = array("d", [0.0]), array("l", [0])

    def __len__(self) -> int:
        return len(self.best)

    def insert(self, word: str) -> int:
        """The count at the word's terminal node; nodes that no earlier word has made are made on the way."""
        child, best, pieces = self.child, self.best, self.pieces
        score, longest, byte = self.vocabulary.score, self.vocabulary.longest, self.vocabulary.byte
        path = [0]
        for end, c in enumerate(word, 1):
            key = path[-1] << 21 | ord(c)
            node = child.get(key)
            if node is None:
                n_bytes = len(c.encode("utf-8", "surrogatepass"))
                top, fewest = best[path[-1]] + n_bytes * byte, pieces[path[-1]] + n_bytes
                for start in range(max(0, end - longest), end):
                    s = score.get(word[start:end])
                    if s is not None:
                        above = path[start]
                        s += best[above]
                        if s > top or (s == top and pieces[above] + 1 < fewest):
                            top, fewest = s, pieces[above] + 1
                node = child[key] = len(best)
                best.append(top)
                pieces.append(fewest)
            path.append(node)
        return pieces[path[-1]]


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.read(path)
        trie, known = Trie(vocabulary), {}
        for batch in batches:
            split = [t.as_py().encode("utf-8", "surrogatepass").split() if t.is_valid else [] for t in batch.column(1)]
            for w in {w for words in split for w in words if w not in known}:
                if len(trie) > NODES_KEPT:
                    trie = Trie(vocabulary)
                known[w] = trie.insert(MARK + w.decode("utf-8", "surrogatepass"))
            n = [len(w) for w in split]
            t = [sum(map(known.__getitem__, w)) for w in split]
            if len(known) > WORDS_KEPT:
                known.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(t, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, tokenizer: str = TOKENIZER, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_tokens for every row of docs; no shuffle.

    Pre-tokens are runs of anything but ASCII white space, each with a mark before it. Null, empty and blank texts have 0
    tokens; repeated rows repeat; a null doc_id stays null; texts and pre-tokens count whole, however long. Columns besides the
    two named ones play no part, whatever their names. An empty table gives an empty result.
    """
    side = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    return side.mapInArrow(_count(tokenizer), "doc_id long, n_words long, n_tokens long")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


