"""Token counts by trie-shared dynamic programming.

Texts are cut in pre-tokens: a space opens one together with the run of letters, of digits or of
other characters behind it, and a change of kind opens another. (One space is put before each
non-empty text.) The distinct pre-tokens that a worker hasn't met are inserted in a trie, level by
level; a node's forward score, the best sum of unigram piece scores over all ways to cut its
prefix in pieces, is computed once however many pre-tokens share the prefix. The number of pieces
at a pre-token's terminal node is stored, and a document's count is the sum over its pre-tokens.

The vocabulary comes from a sentencepiece file. It has ranks, not probabilities, so a piece of rank
r has the Zipf score -ln(r + 1); a byte that no piece covers falls back to a byte piece with a score
below all others. Pieces are told apart by 64-bit hashes of their bytes, as are pre-tokens within
a worker. Of cuts with equal score the one with the longer last piece holds.

A pre-token of over `LONG` bytes (an unspaced script, base64) shares no prefix worth a trie's level: an
Aho-Corasick automaton of the pieces finds all of them in it in one pass, and the same recursion runs over
what it found.

Nulls and empty texts have zero tokens. A pre-token may be of any length. Repeated rows are counted each by
itself, and alike. An empty table gives no rows; columns besides id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import per_row_sum, slices, utf8_buffers

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
MIX = np.uint64(0xD6E8FEB86659FD93)
#: Pre-tokens whose counts a worker keeps before it starts anew.
MEMORY = 1 << 21
#: Pre-tokens of more bytes are counted one by one.
LONG = 256
#: Kinds of bytes: 0 space, 1 letter (or part of a longer UTF-8 character), 2 digit, 3 other.
KIND = np.full(256, 3, np.uint8)
KIND[32] = 0
KIND[48:58] = 2
KIND[65:91] = KIND[97:123] = KIND[128:] = 1


def powers(n: int) -> np.ndarray:
    out = np.full(n, BASE, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Pieces:
    """Hashes and scores of a vocabulary; a piece's hash is sum of (byte + 1) * BASE^(distance from its end)."""

    def __init__(self, pieces: dict[bytes, float], byte_score: float) -> None:
        self.byte_score, self.pieces = byte_score, pieces
        self._automaton: ahocorasick.Automaton | None = None
        self.longest = max(map(len, pieces), default=1)
        hashes = np.array([self.hash(p) for p in pieces], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.scores = hashes[order], np.array(list(pieces.values()), np.float64)[order]
        if len(np.unique(self.hashes)) != len(pieces):
            raise ValueError("two pieces have one hash")
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self._slot(self.hashes)] = True

    @staticmethod
    def hash(piece: bytes) -> int:
        h = 0
        for b in piece:
            h = (h * int(BASE) + b + 1) % (1 << 64)
        return h

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return (h * MIX) >> np.uint64(44)

    def count_long(self, text: bytes) -> int:
        """Pieces in the best cut of one string, by what an automaton finds in it."""
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for piece, value in self.pieces.items():
                self._automaton.add_word(piece.decode("latin-1"), (len(piece), value))
            self._automaton.make_automaton()
        best, count = [0.0] * (len(text) + 1), [0] * (len(text) + 1)
        done, found = 0, None  # cuts up to `done` are known; the best last piece that ends behind it

        def close(end: int) -> int:
            for at in range(done, end):  # of these but the last no piece ends
                best[at + 1], count[at + 1] = best[at] + self.byte_score, count[at] + 1
            if found is not None and found[0] >= best[end]:
                best[end], count[end] = found
            return end

        last = -1
        for at, (length, value) in self._automaton.iter(text.decode("latin-1")):  # longest first at each end
            if at != last:
                if last >= 0:
                    done = close(last + 1)
                for k in range(done, at):
                    best[k + 1], count[k + 1] = best[k] + self.byte_score, count[k] + 1
                done, last, found = at, at, None
            total = value + best[at + 1 - length]
            if found is None or total > found[0]:
                found = (total, count[at + 1 - length] + 1)
        if last >= 0:
            done = close(last + 1)
        found = None
        if done < len(text):
            close(len(text))
        return count[-1]

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None}  # each worker builds its own

    def score(self, h: np.ndarray) -> np.ndarray:
        """Scores of the pieces with these hashes, -inf where there is none."""
        out = np.full(len(h), -np.inf)
        some = np.flatnonzero(self.maybe[self._slot(h)])
        if len(some):
            at = np.minimum(np.searchsorted(self.hashes, h[some]), len(self.hashes) - 1)
            hit = self.hashes[at] == h[some]
            out[some[hit]] = self.scores[at[hit]]
        return out


def read_pieces(path: str) -> Pieces:
    """The pieces of a sentencepiece file, on the driver."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    kept = {sp.id_to_piece(i).replace("▁", " ").encode(): -float(np.log(i + 1.0)) for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    return Pieces(kept, -float(np.log(n + 1.0)) - 10.0)


def trie_counts(data: np.ndarray, begin: np.ndarray, length: np.ndarray, pieces: Pieces) -> np.ndarray:
    """Pieces in the best cut of each string data[begin : begin + length], lengths one or more."""
    out = np.zeros(len(begin), np.int64)
    word = np.argsort(length, kind="stable")[::-1]
    size = length[word]
    node = np.zeros(len(word), np.int64)
    power = powers(pieces.longest + 1)
    # of the last levels: forward scores, counts and prefix hashes of their nodes
    scores, counts, hashes = [np.zeros(1)], [np.zeros(1, np.int64)], [np.zeros(1, np.uint64)]
    ups: list[np.ndarray] = []
    depth = 0
    while len(word):
        byte = data[begin[word] + depth].astype(np.int64)
        keys, node = np.unique(node * 256 + byte, return_inverse=True)
        parent, char = keys >> 8, (keys & 255).astype(np.uint64) + np.uint64(1)
        ups = [parent] + [u[parent] for u in ups[: pieces.longest - 1]]
        own = hashes[-1][parent] * BASE + char
        best = scores[-1][parent] + pieces.byte_score
        count = counts[-1][parent] + 1
        found = np.full(len(keys), -np.inf)
        found_count = np.zeros(len(keys), np.int64)
        for k in range(len(ups), 0, -1):
            up = ups[k - 1]
            with np.errstate(invalid="ignore"):
                total = pieces.score(own - hashes[-k][up] * power[k]) + scores[-k][up]
            better = total > found
            found[better] = total[better]
            found_count[better] = counts[-k][up[better]] + 1
        use = found >= best
        best[use], count[use] = found[use], found_count[use]
        for kept, new in ((scores, best), (counts, count), (hashes, own)):
            kept.append(new)
            del kept[: -pieces.longest]
        depth += 1
        done = int(np.searchsorted(-size, -depth, side="left"))
        out[word[done:]] = count[node[done:]]
        word, size, node = word[:done], size[:done], node[:done]
    return out


def pretokens(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with a space before each non-empty row, starts of pre-tokens, and each row's first one (rows + 1)."""
    sizes = np.diff(offsets)
    filled = sizes > 0
    row_at = np.cumsum(filled) - filled + offsets[:-1]
    total = len(data) + int(filled.sum())
    out = np.full(total, 32, np.uint8)
    where = np.ones(total, bool)
    where[row_at[filled]] = False
    out[where] = data
    kind = KIND[out]
    new = np.ones(total, bool)
    new[1:] = (kind[1:] == 0) | ((kind[1:] != kind[:-1]) & (kind[:-1] != 0))
    starts = np.flatnonzero(new)
    return out, starts, np.searchsorted(starts, np.append(row_at, total))


class Counter:
    """Counts tokens of rows; terminal counts are kept from call to call."""

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        self.known = np.zeros(0, np.uint64)
        self.tokens = np.zeros(0, np.int64)

    def rows(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, pre-tokens) of each row."""
        tokens, _, first = self.each(offsets, data)
        return per_row_sum(tokens, first[:-1], first[1:]), np.diff(first)

    def each(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens and bytes of each pre-token, and each row's first one (rows + 1); a row's first counts the space before it."""
        text, starts, first = pretokens(offsets, data)
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), first
        ends = np.append(starts[1:], len(text))
        within = np.arange(len(text)) - np.repeat(starts, ends - starts)
        value = (text.astype(np.uint64) + np.uint64(1)) * powers(int(within.max()) + 1)[within]
        name = np.add.reduceat(value, starts) * MIX + (ends - starts).astype(np.uint64)
        names, sample, inverse = np.unique(name, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, names)
        old = np.zeros(len(names), bool)
        if len(self.known):
            old = self.known[np.minimum(at, len(self.known) - 1)] == names
        tokens = np.zeros(len(names), np.int64)
        tokens[old] = self.tokens[at[old]]
        new = np.flatnonzero(~old)
        if len(new):
            begin = starts[sample[new]]
            size = ends[sample[new]] - begin
            short = size <= LONG
            tokens[new[short]] = trie_counts(text, begin[short], size[short], self.pieces)
            tokens[new[~short]] = [self.pieces.count_long(text[b : b + n].tobytes()) for b, n in zip(begin[~short].tolist(), size[~short].tolist(), strict=True)]
            if len(self.known) + len(new) > MEMORY:
                self.known, self.tokens, at = self.known[:0], self.tokens[:0], np.zeros(len(names), np.int64)
            self.known, self.tokens = np.insert(self.known, at[new], names[new]), np.insert(self.tokens, at[new], tokens[new])
        return tokens[inverse], ends - starts, first


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, n_bytes, n_pretokens, n_tokens), one per row of `docs`; `vocabulary` is a path on the driver."""
    shared = docs.sparkSession.sparkContext.broadcast(read_pieces(vocabulary))  # a vocabulary file's size, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value)
        for batch in batches:
            offsets, data = utf8_buffers(batch.column(1))
            tokens, pre = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for lo, hi in slices(offsets):
                tokens[lo:hi], pre[lo:hi] = counter.rows(offsets[lo : hi + 1] - offsets[lo], data[offsets[lo] : offsets[hi]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(pre), pa.array(tokens)], names=["id", "n_bytes", "n_pretokens", "n_tokens"])

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    done = picked.mapInArrow(run, f"id {dict(picked.dtypes)['id']}, n_bytes long, n_pretokens long, n_tokens long")
    return done.withColumnRenamed("id", id_col)
