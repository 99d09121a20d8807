"""Byte-level BPE encoding and decoding with DuckDB queries inside Spark tasks.

A task cuts its texts into pre-tokens and gives the new distinct ones to a
recursive query: rows are the tokens at the positions of a word, joined with the
merge table; every round contracts each word's leftmost pair of the smallest
rank, until no pair is left. An ordered aggregation over tokens decodes.

Ids travel as packed little-endian unsigned 32-bit integers.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from itertools import islice

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from flowgauge.llm.common import new_names

#: Distinct chunks and words that a worker keeps; beyond these numbers it starts anew.
MAX_CHUNKS, MAX_WORDS = 250_000, 400_000
#: Texts handled at once, words in one recursive query, and tokens in one decoding query.
ROWS, WORDS, TOKENS = 500, 20_000, 250_000
#: Words of up to so many bytes take the query that holds each round's rows of a word; at this length both queries take as long.
SHORT = 512
#: Rows that a query for short words holds, over all rounds, and bytes of long words in one query.
SHORT_ROWS, LONG_BYTES = 4_000_000, 100_000
#: An odd factor: sums of bytes times its powers tell substrings apart.
FACTOR = 0x9E3779B97F4A7C15
#: Memory of the connection: a fixed part, and bytes for each byte of a long word.
MEMORY_MB, BYTES_A_BYTE = 200, 1000

#: One contraction a word and round. A row knows its right neighbour; the smallest (id, position) of a word wins.
ENCODE = """
with recursive s(w, pos, tok, npos, ntok, step) as (
  select w, pos, tok, npos, ntok, 0 from start
  union all
  (with best as (
     select s.w, min((m.id::bigint << 40) | (s.pos::bigint << 20) | s.npos) b
     from s join merges m on m.pair = ((s.tok::bigint << 32) | s.ntok) where s.ntok >= 0 group by s.w),
   hit as (
     select best.w, (b >> 40)::int id, ((b >> 20) & 1048575)::int pos, gone.pos gone, gone.npos, gone.ntok
     from best join s gone on gone.w = best.w and gone.pos = (b & 1048575)::int)
   select s.w, s.pos,
          case when s.pos = hit.pos then hit.id else s.tok end,
          case when s.pos = hit.pos then hit.npos else s.npos end,
          case when s.pos = hit.pos then hit.ntok when s.npos = hit.pos then hit.id else s.ntok end,
          s.step + 1
   from s join hit on s.w = hit.w where s.pos <> hit.gone))
select s.w, list(s.tok order by s.pos) toks
from s join (select w, max(step) step from s group by w) f on s.w = f.w and s.step = f.step
group by s.w order by s.w
"""

#: The same rule for a long word, seen in parts of ``{reach}`` bytes: four times the longest piece that occurs in it. A pair
#: of a part's smallest rank is next in its surroundings where neither neighbouring part has a smaller one: a piece that
#: ended or started at one of its tokens would lie inside the three parts, and so would the smaller pair that begins it.
#: Where the merged piece is ``calm``, that is, takes no part in a pair of a smaller rank whose piece occurs, a round contracts all such pairs
#: from left to right (every other one of a run of overlapping pairs, if the run's start is among them); else just a part's
#: leftmost, if neither neighbour has one of that rank before it. Rows are keyed by (word, position), and a round gives only
#: those that change: memory follows the word's length and not its rounds.
ENCODE_LONG = """
with recursive s(w, pos, prv, nxt, tok, ntok, k) using key (w, pos) as (
  select w, pos, pos - 1, npos, tok, ntok, coalesce((m.id::bigint << 32) | pos, 9223372036854775807)
  from start left join long_merges m on m.pair = tok::bigint * 4294967296 + ntok
  union
  (with low as (
     select w, pos // {reach} part, min(k) k from recurring.s group by all having min(k) < 9223372036854775807),
   hit as (
     select a.w, a.part, (a.k >> 32)::int id, (a.k & 4294967295)::int pos, calm
     from (select low.*, m.calm, case when m.calm then (k >> 32) << 32 else k end least from low join (select distinct id, calm from long_merges) m on m.id = (k >> 32)::int) a
     left join low b on b.w = a.w and b.part = a.part - 1 left join low c on c.w = a.w and c.part = a.part + 1
     where a.least <= coalesce(b.k, 9223372036854775807) and a.least <= coalesce(c.k, 9223372036854775807)),
   near as (
     select w, part, id, max(pos) pos, bool_or(own) own
     from (select w, part, id, case when calm then -1 else pos end pos, true own from hit
           union all select w, part - 1, id, -1, false from hit where calm)
     group by all),
   alike as (
     select s.w, s.pos, s.prv, s.nxt gone, near.id, near.own,
            lag(s.nxt) over (partition by s.w order by s.pos) is distinct from s.pos or lag(near.id) over (partition by s.w order by s.pos) <> near.id starts
     from near join recurring.s s on s.w = near.w and s.pos // {reach} = near.part and (s.k >> 32)::int = near.id
     where near.pos < 0 or s.pos = near.pos),
   runs as (select *, sum(starts::int) over (partition by w order by pos) run from alike),
   taken as (
     select r.w, r.pos, r.prv, r.gone, r.id, s.nxt after, s.ntok after_tok
     from (select * from runs
           qualify row_number() over (partition by w, run order by pos) % 2 = 1 and bool_and(own) over (partition by w, run order by pos)) r
     join recurring.s s on s.w = r.w and s.pos = r.gone),
   touched as (select distinct w, unnest([pos, prv, after]) pos from taken),
   changed as (
     select s.w, s.pos, coalesce(back.pos, s.prv) prv, coalesce(own.after, s.nxt) nxt, coalesce(own.id, s.tok) tok,
            coalesce(next.id, own.after_tok, s.ntok) ntok
     from touched t join recurring.s s on s.w = t.w and s.pos = t.pos
     left join taken own on own.w = s.w and own.pos = s.pos
     left join taken back on back.w = s.w and back.gone = s.prv
     left join taken next on next.w = s.w and next.pos = coalesce(own.after, s.nxt)
     where not exists (select 1 from taken x where x.w = s.w and x.gone = s.pos)
     union all select w, gone, -1, -1, -1, -1 from taken)
   select c.w, c.pos, c.prv, c.nxt, c.tok, c.ntok, coalesce((m.id::bigint << 32) | c.pos, 9223372036854775807)
   from changed c left join long_merges m on m.pair = c.tok::bigint * 4294967296 + c.ntok))
select w, list(tok order by pos) toks from s where tok >= 0 group by w order by w
"""

#: The pieces of each text's ids in order.
DECODE = """
select d, list(piece order by p) pieces from tokens left join vocab using (id) group by d order by d
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file's pieces: a base64 piece and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """``(left id << 32 | right id, merged id)`` of every split of a piece into two pieces."""
    pairs = [
        (left << 32 | right, rank)
        for piece, rank in ranks.items()
        for k in range(1, len(piece))
        if (left := ranks.get(piece[:k])) is not None and (right := ranks.get(piece[k:])) is not None
    ]
    table = np.array(pairs, np.int64).reshape(-1, 2)
    return table[:, 0], table[:, 1].astype(np.int32)


def _gather(offsets: np.ndarray, flat: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists ``rows`` of a list array, flat, and their offsets."""
    counts = offsets[rows + 1] - offsets[rows]
    out = np.concatenate([[0], np.cumsum(counts)])
    return flat[np.repeat(offsets[rows] - out[:-1], counts) + np.arange(out[-1])], out


def _append(lists: tuple[np.ndarray, np.ndarray], offsets: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    old, kept = lists
    return np.concatenate([old, old[-1] + offsets[1:]]), np.concatenate([kept, flat])


class _Numbers(dict):
    """Numbers keys in the order in which they come."""

    def __missing__(self, key: str) -> int:
        value = self[key] = len(self)
        return value


def _shared(some: np.ndarray, sizes: np.ndarray, power: int, most: int) -> Iterator[list[int]]:
    """Words of about one length for one query: as many as ``most`` holds by a power of their sizes, or a larger one by itself."""
    order = some[np.argsort(sizes[some], kind="stable")]
    total = np.cumsum(sizes[order] ** power)
    start, before = 0, 0
    while start < len(order):
        stop = int(np.searchsorted(total, before + most, "right"))
        stop = max(start + 1, min(stop, start + WORDS))
        yield order[start:stop].tolist()
        start, before = stop, int(total[stop - 1])


class Coder:
    """Encodes and decodes batches of texts with one DuckDB connection."""

    def __init__(self, ranks: dict[bytes, int], pairs: np.ndarray, merged: np.ndarray, pattern: str):
        self.pattern = regex.compile(pattern)
        self.ranks, self.pairs, self.merged = ranks, pairs, merged
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.db = duckdb.connect()
        # no folder to spill to: what a query holds is bounded, and the worker's own folder may be read-only
        for setting in ("threads = 1", "preserve_insertion_order = false", "temp_directory = ''", f"memory_limit = '{MEMORY_MB}MB'"):
            self.db.execute(f"set {setting}").fetchall()
        self._table("m", {"pair": pairs, "id": merged})
        self.db.execute("create table merges as select * from m").fetchall()
        self._table("v", {"id": pa.array(list(ranks.values()), pa.int32()), "piece": pa.array(list(ranks), pa.binary())})
        self.db.execute("create table vocab as select * from v").fetchall()
        self.sizes: dict[int, list[bytes]] = {}
        self.words, self.chunks = _Numbers(), _Numbers()
        self.word_tokens = self.chunk_tokens = self.empty = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def _table(self, name: str, columns: dict) -> None:
        self.db.register(name, pa.table(columns))

    def _merge(self, pieces: list[bytes], sql: str) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        tok = self.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
        start = np.cumsum(sizes) - sizes
        pos = (np.arange(len(tok)) - np.repeat(start, sizes)).astype(np.int32)
        last = pos == np.repeat(sizes, sizes) - 1
        self._table(
            "start",
            {
                "w": np.repeat(np.arange(len(pieces), dtype=np.int32), sizes),
                "pos": pos,
                "tok": tok,
                "npos": np.where(last, -1, pos + 1).astype(np.int32),
                "ntok": np.where(last, -1, np.append(tok[1:], -1)).astype(np.int32),
            },
        )
        lists = self.db.sql(sql).to_arrow_table()["toks"].combine_chunks()
        return np.asarray(lists.offsets, np.int64), np.asarray(lists.values, np.int32)

    def _encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token lists of distinct, non-empty words, in their order."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        whole = np.fromiter((-1 if r is None else r for r in map(self.ranks.get, words)), np.int32, len(words))
        known = np.flatnonzero(whole >= 0)
        at, counts, flat = [known], [np.ones(len(known), np.int64)], [whole[known]]
        # a word of n bytes has n rounds of n rows at most
        for some in _shared(np.flatnonzero((whole < 0) & (sizes <= SHORT)), sizes, 2, SHORT_ROWS):
            self._add(at, counts, flat, some, self._merge([words[k] for k in some], ENCODE))
        for some in _shared(np.flatnonzero((whole < 0) & (sizes > SHORT)), sizes, 1, LONG_BYTES):
            self._add(at, counts, flat, some, self._encode_long([words[k] for k in some]))
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        tokens, ends = _gather(offsets, np.concatenate(flat), np.argsort(np.concatenate(at), kind="stable"))
        return ends, tokens

    @staticmethod
    def _add(at: list, counts: list, flat: list, some: list[int], lists: tuple[np.ndarray, np.ndarray]) -> None:
        offsets, tokens = lists
        at.append(np.array(some, np.int64))
        counts.append(np.diff(offsets))
        flat.append(tokens[offsets[0] : offsets[-1]])

    def _occurring(self, words: list[bytes]) -> tuple[np.ndarray, int]:
        """Ids of the pieces that occur in any of the words (some more, by chance: they are found by hash), and the longest's length."""
        if not self.sizes:
            for piece in self.ranks:
                self.sizes.setdefault(len(piece), []).append(piece)
        text = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words])
        left = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(len(text))  # bytes from each place to its word's end
        powers = np.full(len(text), FACTOR, np.uint64)
        powers[0] = 1
        powers = np.cumprod(powers)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(text * powers)])
        ids, longest = [], 1
        for size in sorted(n for n in self.sizes if n <= left.max()):
            pieces = self.sizes[size]
            rows = np.frombuffer(b"".join(pieces), np.uint8).reshape(-1, size)
            # a piece at place i adds up to its own sum times the place's power
            own = (rows * powers[:size]).sum(axis=1, dtype=np.uint64) * powers[len(text) - size]
            inside = (sums[size:] - sums[:-size]) * powers[len(text) - size :: -1]
            there = np.nonzero(np.isin(own, inside[left[: len(inside)] >= size]))[0]
            if len(there):
                ids += [self.ranks[pieces[k]] for k in there.tolist()]
                longest = size
        return np.array(ids, np.int32), longest

    def _encode_long(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token lists of long words by one query, with the pairs whose piece occurs in any of them."""
        ids, longest = self._occurring(words)
        use = np.isin(self.merged, ids)
        pairs, merged = self.pairs[use], self.merged[use]
        uneasy = np.concatenate([side[merged < side] for side in (pairs >> 32, pairs & 0xFFFFFFFF)])
        self._table("m", {"pair": pairs, "id": merged, "calm": ~np.isin(merged, uneasy)})
        self.db.execute("create or replace table long_merges as select * from m").fetchall()
        self.db.execute(f"set memory_limit = '{MEMORY_MB + BYTES_A_BYTE * sum(map(len, words)) // 1_000_000}MB'").fetchall()
        found = self._merge(words, ENCODE_LONG.format(reach=4 * longest))
        self.db.execute(f"set memory_limit = '{MEMORY_MB}MB'").fetchall()
        return found

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.chunks) > MAX_CHUNKS:
            self.chunks, self.chunk_tokens = _Numbers(), self.empty
        if len(self.words) > MAX_WORDS:
            self.words, self.word_tokens = _Numbers(), self.empty
        known = len(self.chunks)
        rows = [np.fromiter(map(self.chunks.__getitem__, c), np.int64, len(c)) for c in map(chunks, texts)]
        fresh = list(islice(self.chunks, known, None))
        if fresh:
            known = len(self.words)
            cut = [list(map(self.words.__getitem__, self.pattern.findall(c))) for c in fresh]
            new = [w.encode("utf-8", "surrogatepass") for w in islice(self.words, known, None)]
            if new:
                self.word_tokens = _append(self.word_tokens, *self._encode_words(new))
            sizes = np.fromiter(map(len, cut), np.int64, len(cut))
            flat, ends = _gather(*self.word_tokens, np.fromiter((w for c in cut for w in c), np.int64, sizes.sum()))
            self.chunk_tokens = _append(self.chunk_tokens, ends[np.concatenate([[0], np.cumsum(sizes)])], flat)
        return [_gather(*self.chunk_tokens, r)[0].astype("<u4").tobytes() for r in rows]

    def decode(self, packed: list[bytes | None]) -> list[bytes | None]:
        out: list[bytes | None] = [None if x is None else b"" for x in packed]
        part: list[tuple[int, np.ndarray]] = []
        size = 0
        for k, x in enumerate(packed):
            if x:
                part.append((k, np.frombuffer(x, "<u4").astype(np.int32)))
                size += len(part[-1][1])
            if part and (size >= TOKENS or k == len(packed) - 1):
                sizes = [len(ids) for _, ids in part]
                self._table(
                    "tokens",
                    {
                        "d": np.repeat(np.array([d for d, _ in part], np.int32), sizes),
                        "p": np.arange(size, dtype=np.int32),
                        "id": np.concatenate([ids for _, ids in part]),
                    },
                )
                found = self.db.sql(DECODE).to_arrow_table()
                lists = found["pieces"].combine_chunks()
                if lists.values.null_count:
                    raise ValueError("an id is not in the vocabulary")
                # the pieces lie one after another in one buffer: a text is a slice of it
                pieces = lists.values.cast(pa.large_binary())
                _, bounds, data = pieces.buffers()
                at = np.frombuffer(bounds, np.int64)[pieces.offset :][np.asarray(lists.offsets)].tolist()
                for d, s, e in zip(found["d"].to_pylist(), at, at[1:]):
                    out[d] = data[s:e].to_pybytes()
                part, size = [], 0
        return out


_EDGE = re.compile(r" \s|\s |^ | $")
_CUT = re.compile(r"(?<=\S) (?=\S)")


def chunks(text: str | None) -> list[str]:
    """Cuts a text before each space that stands alone between two other characters.

    The pattern always starts a match there, as such a space can only be the
    optional first character of the match that takes what follows.
    """
    if not text:
        return []
    first, *rest = _CUT.split(text) if _EDGE.search(text) else text.split(" ")
    return [first, *[" " + x for x in rest]]


def _with_coder(table: DataFrame, vocabulary: str, pattern: str, code: Callable, outs: list[str]) -> DataFrame:
    """``table`` with the binary columns ``outs`` that ``code(coder, batch)`` makes."""
    new_names(table, *outs)
    ranks = read_ranks(vocabulary)
    # a worker unpacks a broadcast value once: the coder that it makes serves all of its tasks
    held = table.sparkSession.sparkContext.broadcast({"ranks": ranks, "merges": merge_table(ranks)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = held.value
        coder = shared.get("coder")
        if coder is None:
            coder = shared["coder"] = Coder(shared["ranks"], *shared["merges"], pattern)
        for b in (whole.slice(k, ROWS) for whole in batches for k in range(0, whole.num_rows, ROWS)):
            new = [pa.array(x, pa.binary()) for x in code(coder, b)]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, *outs])

    return table.mapInArrow(run, T.StructType([*table.schema.fields, *[T.StructField(o, T.BinaryType()) for o in outs]]))


def bpe_encode(
    docs: DataFrame, vocabulary: str, pattern: str, column: str = "text", out: str = "ids", decoded: str | None = None
) -> DataFrame:
    """``docs`` with ``out``: the packed ids of ``column``, whole texts, without special tokens.

    ``vocabulary`` is a rank file (its path on the driver) with a piece for
    every byte, ``pattern`` cuts texts into pre-tokens. A pre-token that is a
    piece becomes that piece; any other is merged. Null and empty texts have no
    ids. All columns and rows are kept; ``out`` must be a new name, else a
    ``ValueError`` says so. ``decoded`` names a further column with what the ids
    decode to, made by the same worker.
    """

    def code(coder: Coder, b: pa.RecordBatch) -> list[list]:
        ids = coder.encode(b.column(b.schema.get_field_index(column)).to_pylist())
        return [ids, coder.decode(ids)] if decoded else [ids]

    return _with_coder(docs, vocabulary, pattern, code, [out, decoded] if decoded else [out])


def bpe_decode(table: DataFrame, vocabulary: str, column: str = "ids", out: str = "decoded") -> DataFrame:
    """``table`` with ``out``: the bytes that the packed ids of ``column`` stand for; null for null.

    An id that the vocabulary lacks is an error, and so is an ``out`` that
    ``table`` already has.
    """

    def code(coder: Coder, b: pa.RecordBatch) -> list[list]:
        return [coder.decode(b.column(b.schema.get_field_index(column)).to_pylist())]

    return _with_coder(table, vocabulary, "", code, [out])
