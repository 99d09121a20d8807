"""Token counts of a unigram tokenizer, by dynamic programming over a trie of pre-tokens.

The distinct pre-tokens of a batch are inserted into a trie, byte by byte. The
forward score of a node - the best log-probability of any split of the bytes
from the root to it into pieces - is worked out once, when the node is made, so
pre-tokens with a common beginning share it. Terminal nodes keep the number of
pieces of the best split, and a text's count is their sum.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from flowgauge.llm.common import new_names

#: Trie nodes that a task keeps; beyond it starts anew.
MAX_NODES = 1_000_000
#: Texts handled at once.
ROWS = 500


def zipf_scores(path: str) -> dict[bytes, float]:
    """Unigram log-probabilities of a rank file's pieces: the piece of rank r has a weight of 1 / (r + 1)."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    norm = math.log(sum(1 / (r + 1) for r in ranks.values()))
    return {piece: -math.log(r + 1) - norm for piece, r in ranks.items()}


class Trie:
    """Pre-tokens inserted so far, with forward scores and, at terminal nodes, token counts."""

    def __init__(self, scores: dict[bytes, float]):
        self.scores = scores
        self.longest = max(map(len, scores))
        self.clear()

    def clear(self) -> None:
        self.children: dict[int, int] = {}  # node << 8 | byte to node
        self.best = [0.0]  # forward score of each node; the root's is 0
        self.count = [0]  # pieces of the split that has it
        self.terminal: dict[str, int] = {}  # pre-token to its token count

    def insert(self, token: str) -> int:
        """The token count of a pre-token; ties go to the split with fewer pieces."""
        if (known := self.terminal.get(token)) is not None:
            return known
        if len(self.best) > MAX_NODES:
            self.clear()
        raw = token.encode("utf-8", "surrogatepass")
        path = [0]  # nodes of the prefixes of raw
        children, best, count, scores, longest = self.children, self.best, self.count, self.scores, self.longest
        for end, byte in enumerate(raw, 1):
            key = path[-1] << 8 | byte
            node = children.get(key)
            if node is None:
                top, pieces = -math.inf, 0
                for start in range(max(0, end - longest), end):
                    score = scores.get(raw[start:end])
                    if score is not None:
                        score += best[path[start]]
                        n = count[path[start]] + 1
                        if score > top or score == top and n < pieces:
                            top, pieces = score, n
                node = children[key] = len(best)
                best.append(top)
                count.append(pieces)
            path.append(node)
        self.terminal[token] = count[path[-1]]
        return count[path[-1]]


def count_tokens(docs: DataFrame, scores: dict[bytes, float], pattern: str, column: str = "text", out: str = "n_tokens") -> DataFrame:
    """``docs`` with ``out`` (long): the tokens of ``column`` under the most probable split of each pre-token.

    ``scores`` has a log-probability for every piece, every single byte among
    them, so that each text can be split; it is broadcast, a vocabulary being of
    fixed size. ``pattern`` cuts whole texts into pre-tokens. Null and empty
    texts have no tokens. All columns and rows are kept; ``out`` must be a new
    name, else a ``ValueError`` says so.
    """
    new_names(docs, out)
    lacking = [b for b in range(256) if bytes([b]) not in scores]
    if lacking:
        raise ValueError(f"no score for the bytes {lacking[:5]}")
    held = docs.sparkSession.sparkContext.broadcast(scores)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, find = Trie(held.value), regex.compile(pattern).findall
        for b in (whole.slice(k, ROWS) for whole in batches for k in range(0, whole.num_rows, ROWS)):
            texts = b.column(b.schema.get_field_index(column)).to_pylist()
            cut = [find(t) if t else [] for t in texts]
            counts = {w: trie.insert(w) for w in set().union(*cut)}
            n = [sum(map(counts.__getitem__, c)) for c in cut]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.array(n, np.int64))], names=[*b.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.LongType())]))
