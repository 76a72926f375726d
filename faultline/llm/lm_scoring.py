"""Language-model scores by logistic context mixing over bits.

A text is read as its words (ASCII lower case) and one end. Every token is a string of bits:
the ``common`` commonest training words, the end and an escape have a prefix code (Huffman's,
from their training counts); behind an escape the word is spelled in its bytes, eight bits
each. Every bit is predicted from several contexts, whose logits are mixed by weights that a
gate selects (how deep the bit lies, and how much the longer contexts know) and that are
refined online while texts are coded. The score is the log10 probability of the text; divided
by its bytes and log10(2) it is bits per byte.

Contexts of a code bit: none, the word before, the two words before. What they have seen
comes from all training texts, exactly: the words of a text become symbols; about
``GROUP_TOKENS`` symbols of whole texts are a group; a group sends its pairs of context and
symbol, with their counts, to buckets of contexts; a bucket sums them and returns, for each
pair, the logits on the way to its symbol. Groups and buckets grow in number with the
input, not in size, and texts themselves are never moved. A pair's key holds its symbols,
so nothing collides. Contexts of a spelled bit are the one and the two bytes before, counted
over the distinct words of the training texts; their number is bounded by the byte values.

A training text is scored by what the others say: each of its tokens is judged by counts
from which that token itself is taken off. A copy elsewhere still counts, so texts that
occur twice score higher than texts that occur once.

The base score takes exact word counts over all training texts. Counts of the common words
are looked up in the tasks (a table of fixed size); the others go through a join on the
word, pre-summed per text.

Null counts as empty (one end). Every row is a text of its own, whatever its doc_id. Extra
columns are ignored. An empty table gives an empty result; without training texts nothing
is known and every unknown bit costs one bit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import LOWER, blocks, mixed, word_hashes, word_spans
from .langid import fold
from .scratch import Scratch
from .text_sql import masked, unmasked

#: Bits of a symbol's number; and how many words have one (two numbers are the end's and the escape's).
SYMBOL_BITS = 18
COMMON_WORDS = (1 << SYMBOL_BITS) - 2
#: Code bits are held from the highest of so many.
CODE_BITS = 48
#: Symbols of a group (of whole texts), tokens between two refinements of the weights, texts' bytes of a block.
GROUP_TOKENS, LEARN_TOKENS, TEXT_BLOCK = 1 << 20, 1 << 16, 1 << 20
#: Groups are scored in so many turns.
WAVES = 4
#: Steps to the unit of a stored logit.
STEPS = 4
#: Added to both sides of a count.
PRIOR = 0.04
#: Gates tell this many code bits apart.
DEPTHS = 16
DAMPING, DECAY = 30.0, 0.98


# --- small helpers -------------------------------------------------------------------------


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ..., start[0] + length[0] - 1, start[1], ..."""
    total = int(length.sum())
    kind = np.int32 if total < 1 << 31 and (not total or int(start.max()) + int(length.max()) < 1 << 31) else np.int64
    out = np.repeat((start - np.cumsum(length) + length).astype(kind), length)
    out += np.arange(total, dtype=kind)
    return out


def packed(x: np.ndarray) -> bytes:
    """Byte by byte, all lowest bytes first, compressed."""
    return squeezed(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())


def unpacked(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(unsqueezed(data), np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def packed_keys(x: np.ndarray) -> bytes:
    """Rising numbers, as steps."""
    return packed(np.diff(x, prepend=np.zeros(1, np.uint64)))


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, np.uint64), dtype=np.uint64)


def squeezed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def unsqueezed(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def steps(right: np.ndarray, wrong: np.ndarray) -> np.ndarray:
    """The logit of being right from counts, in STEPS to the unit; 0 stands for nothing seen, or as much on either side."""
    t = np.log((right.astype(np.float32) + np.float32(PRIOR)) / (wrong.astype(np.float32) + np.float32(PRIOR)))
    out = np.rint(np.clip(t, -15, 15) * STEPS).astype(np.int8)
    return np.where(out == 0, np.sign(right - wrong), out).astype(np.int8)


# --- words, their letters and their code ---------------------------------------------------


def spell(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of words, each with a space behind it; one byte before, two before; and the word of each place."""
    size = ends - starts + 1
    at = np.cumsum(size) - size
    out = np.full(int(size.sum()), 32, np.uint8)
    out[ragged(at, size - 1)] = data[ragged(starts, size - 1)]
    one, two = np.full_like(out, 32), np.full_like(out, 32)
    one[1:] = out[:-1]
    two[2:] = out[:-2]
    two[at] = 32
    return out, one, two, np.repeat(np.arange(len(size)), size)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, key, n): kind 0 counts words by hash, kind 1 three bytes in a row over the distinct words of each block."""

    def out(kind: int, held: list) -> pa.RecordBatch:
        keys = np.concatenate([k for k, _ in held])
        order = np.argsort(keys)
        keys, counts = keys[order], np.concatenate([n for _, n in held])[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(first), kind, np.int32)), pa.array(keys[first].view(np.int64)), pa.array(np.add.reduceat(counts, first))], names=["kind", "key", "n"])

    words: list = []
    letters: list = []
    size = 0
    for b in blocks(batches):
        low = LOWER[b.data]
        starts, ends, _ = word_spans(low, b.offsets)
        if not len(starts):
            continue
        own, at, n = np.unique(word_hashes(low, starts, ends), return_index=True, return_counts=True)
        words.append((own, n))
        c, one, two, _ = spell(low, starts[at], ends[at])
        three, m = np.unique(two.astype(np.uint32) << np.uint32(16) | one.astype(np.uint32) << np.uint32(8) | c, return_counts=True)
        letters.append((three.astype(np.uint64), m))
        size += len(own) + len(three)
        if size > 1_000_000:
            yield out(0, words)
            yield out(1, letters)
            words, letters, size = [], [], 0
    if words:
        yield out(0, words)
        yield out(1, letters)


def letter_logits(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From counts of three bytes in a row: the row of each pair of bytes (-1: unseen), logits by row and node, and logits by one byte and node."""
    pair = (keys >> 8).astype(np.int64)
    seen = np.unique(pair)
    row = np.full(1 << 16, -1, np.int32)
    row[seen] = np.arange(len(seen))
    two = np.zeros((len(seen) + 1, 256))
    np.add.at(two, (row[pair], keys & 255), n)
    one = np.zeros((256, 256))
    np.add.at(one, (pair & 255, keys & 255), n)
    out = []
    for counts in (two, one):
        t = np.zeros(counts.shape, np.float32)
        for level in range(8):
            x = counts.reshape(len(counts), 1 << level, 2, -1).sum(axis=3)
            own = np.log((x[:, :, 1] + 0.4) / (x[:, :, 0] + 0.4))
            t[:, 1 << level : 2 << level] = np.where(x.sum(axis=2) > 0, own, 0)
        out.append(np.clip(t, -12, 12).reshape(-1))
    return row, out[0], out[1]


#: Words are looked up by so many leading bits of their hash: one word shares them, on the average.
HEAD_BITS = SYMBOL_BITS


def heads(words: np.ndarray) -> np.ndarray:
    """Where the words (hashes, rising) with each value of the leading bits begin, and the end of the last."""
    n = np.bincount((words >> np.uint64(64 - HEAD_BITS)).astype(np.int64), minlength=1 << HEAD_BITS)
    return np.concatenate([[0], np.cumsum(n)]).astype(np.int32)


def places(words: np.ndarray, head: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Where each of h is among words, or -1."""
    top = (h >> np.uint64(64 - HEAD_BITS)).astype(np.int64)
    at, end = head.take(top), head.take(top + 1)
    out = np.full(len(h), -1, np.int32)
    rest = np.flatnonzero(at < end)
    at, end, h = at[rest], end[rest], h[rest]
    while len(rest):
        own = words.take(at)
        hit = own == h
        out[rest[hit]] = at[hit]
        more = np.flatnonzero((own < h) & (at + 1 < end))
        rest, at, end, h = rest[more], at[more] + 1, end[more], h[more]
    return out


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Lengths of a Huffman code for counts that rise."""
    n = len(counts)
    if n < 2:
        return np.ones(n, np.int64)
    weight, parent = [*counts.tolist(), *[0] * (n - 1)], [0] * (2 * n - 1)
    leaf, node = 0, n
    for k in range(n, 2 * n - 1):
        total = 0
        for _ in range(2):
            if node >= k or leaf < n and weight[leaf] <= weight[node]:
                one, leaf = leaf, leaf + 1
            else:
                one, node = node, node + 1
            total += weight[one]
            parent[one] = k
        weight[k] = total
    depth = [0] * (2 * n - 1)
    for k in range(2 * n - 3, -1, -1):
        depth[k] = depth[parent[k]] + 1
    return np.array(depth[:n])


class Code:
    """Symbols by rising code: their lengths, codes and counts, the logits without context; and the symbol of each common word."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, end: int, rest: int):
        """words (hashes, rising) with their counts, how many ends there are, and words without a symbol."""
        n = np.concatenate([counts, [end, rest]]).astype(np.int64)
        # Counts far below the total are raised, which bounds the length of a code.
        weight = np.maximum(n, max(1, int(n.sum()) >> 30))
        rising = np.lexsort((np.arange(len(n)), weight))
        length = np.empty(len(n), np.int64)
        length[rising] = code_lengths(weight[rising])
        order = np.lexsort((np.arange(len(n)), length))
        symbol = np.empty(len(n), np.uint32)
        symbol[order] = np.arange(len(n))
        self.words, self.word_counts, self.word_symbols = words, counts.astype(np.int64), symbol[:-2]
        self.end, self.escape = int(symbol[-2]), int(symbol[-1])
        self.lengths = length[order].astype(np.uint8)
        size = np.uint64(1) << (CODE_BITS - length[order]).astype(np.uint64)
        self.codes = np.cumsum(size) - size
        full, less = path_logits(np.zeros(1, np.int64), self.codes, self.lengths.astype(np.int64), n[order])
        #: Logits without context: those of training tokens come first, then those of held-out ones.
        self.plain = np.concatenate([less, full])
        self.begin = np.cumsum(length[order]) - length[order]


def path_logits(first: np.ndarray, code: np.ndarray, length: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logits (as steps) of being right on the way to each symbol, pair by pair, bit by bit; and the same without one of its occurrences.

    Pairs of a context lie together from ``first`` on, by rising code.
    """
    # Where a pair is alone under a node, all further bits have its own count on one side.
    nothing = np.zeros(len(n), np.int64)
    full, less = np.repeat(steps(n, nothing), length), np.repeat(steps(np.maximum(n - 1, 0), nothing), length)
    if not len(n):
        return full, less
    at = np.cumsum(length) - length
    size = np.diff(np.append(first, len(n)))
    above, head = np.repeat(np.add.reduceat(n, first), size), np.repeat(np.arange(len(first), dtype=np.int32), size)
    stay = np.repeat(size > 1, size)
    level = 0
    while True:
        code, length, n, above, at, head = (x[stay] for x in (code, length, n, above, at, head))
        if not len(n):
            return full, less
        level += 1
        prefix = code >> np.uint64(CODE_BITS - level)
        edge = np.ones(len(n), bool)
        edge[1:] = (prefix[1:] != prefix[:-1]) | (head[1:] != head[:-1])
        starts = np.flatnonzero(edge)
        size = np.diff(np.append(starts, len(n)))
        own = np.repeat(np.add.reduceat(n, starts), size)
        wrong = above - own
        full[at + (level - 1)] = steps(own, wrong)
        less[at + (level - 1)] = steps(np.maximum(own - 1, 0), wrong)
        # Symbols that end here leave; no other symbol lies under their node.
        above, stay = own, np.repeat(size > 1, size) & (length > level)


# --- mixing --------------------------------------------------------------------------------


class Mixer:
    """Weights by gate and input. Inputs are logits of the bit that came; so a cost is ln(1 + e^-z), and weights rise with inputs that were right."""

    def __init__(self, gates: int, start: list[float]):
        self.w = np.tile(np.array(start, np.float32)[:, None], gates)
        self.slope, self.curve = np.zeros(self.w.shape), np.full(gates, DAMPING)

    def cost(self, t: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        """Natural-log costs of bits."""
        z = np.zeros(len(gate), np.float32)
        size = np.zeros(len(gate), np.float32)
        for w, x in zip(self.w, t, strict=True):
            z -= w.take(gate, mode="clip") * x
            size += x * x
        e = np.exp(np.clip(z, -40, 40, out=z), out=z)
        one = e + np.float32(1)
        wrong = np.divide(e, one, out=e)
        size *= wrong
        size -= size * wrong
        for i, x in enumerate(t):
            self.slope[i] += np.bincount(gate, wrong * x, self.w.shape[1])
        self.curve += np.bincount(gate, size, self.w.shape[1]) * len(t)
        return np.log(one, out=one)  # log1p takes six times as long, and costs differ by a float's rounding

    def learn(self) -> None:
        """Refines the weights by what was coded since the last time: damped steps, shorter as more is known."""
        self.w += (self.slope / self.curve).astype(np.float32)
        self.slope[:] = 0
        self.curve = DAMPING + (self.curve - DAMPING) * DECAY


class Speller:
    """Costs of words spelled byte by byte."""

    def __init__(self, letters: tuple[np.ndarray, np.ndarray, np.ndarray]):
        self.row, self.two, self.one = letters
        self.mixer = Mixer(16, [0.3, 0.7])

    def costs(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        c, one, two, word = spell(data, starts, ends)
        rows = self.row[two.astype(np.int32) << 8 | one].astype(np.int64)
        rows[rows < 0] = len(self.two) // 256 - 1  # the last row is empty
        total = np.zeros(len(c), np.float32)
        for level in range(8):
            node = 1 << level | c >> np.uint8(8 - level) if level else np.ones(len(c), np.int64)
            side = ((c >> np.uint8(7 - level) & 1).astype(np.float32) * 2) - 1
            t = [self.one.take(one.astype(np.int64) << 8 | node) * side, self.two.take(rows << 8 | node) * side]
            total += self.mixer.cost(t, level * 2 + (t[1] != 0))
        self.mixer.learn()
        return np.bincount(word, total, len(starts))


# --- texts to symbols ----------------------------------------------------------------------


CODED = "kind int, row long, doc_id long, held boolean, word long, times long, n_tokens long, known long, base double, spelled double, symbols binary, sizes binary, helds binary"
CODED_SCHEMA = pa.schema([(c, {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary()}[k]) for c, k in map(str.split, CODED.split(", "))])


def _rows(n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in CODED_SCHEMA], schema=CODED_SCHEMA)


def _coded(shared, group_tokens: int):
    """Kind 0: a row per text, with what the common words give to the base score and what spelling costs (times: its bytes).
    Kind 1: a row per text and word that is not common. Kind 2: a row per group; its texts' rows follow each other from ``row`` on.
    """

    def group(row: int, held: list) -> pa.RecordBatch:
        symbols, sizes, helds = (np.concatenate(x) for x in zip(*held, strict=True))
        return _rows(1, kind=[2], row=[row], symbols=[packed(symbols)], sizes=[packed(sizes.astype(np.uint32))], helds=[helds.astype(np.uint8).tobytes()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, counts, of_word, end, escape, end_count, share, letters = shared.value
        speller, head = Speller(letters), heads(words)
        row = first_row = TaskContext.get().partitionId() << 40
        held: list = []
        size = 0
        for b in blocks(batches, TEXT_BLOCK):
            n, out = len(b.doc_id), b.batch.column("held").to_numpy(zero_copy_only=False)[b.rows].astype(bool)
            low = LOWER[b.data]
            starts, ends, first = word_spans(low, b.offsets)
            h = word_hashes(low, starts, ends)
            at = places(words, head, h)
            common = at >= 0
            own = np.diff(first)
            doc = np.repeat(np.arange(n), own)
            rare, near = ~common, at[common]
            begin = np.cumsum(own + 1) - own - 1
            symbols = np.full(len(h) + n, end, np.uint32)
            place = np.arange(len(h)) + doc
            symbols[place[common]], symbols[place[rare]] = of_word[near], escape
            spelled = np.bincount(doc[rare], -speller.costs(low, starts[rare], ends[rare]), n) if rare.any() else np.zeros(n)
            gain = np.zeros(len(symbols))
            gain[place[common]] = np.log10(counts[near] + 1.0)
            base = np.add.reduceat(gain, begin) + np.log10(end_count + 1.0) - (own + 1) * share
            known = np.bincount(doc[common], minlength=n) + int(end_count > 0)
            rows = row + np.arange(n)
            yield _rows(n, kind=np.zeros(n, np.int32), row=rows, doc_id=b.doc_id, held=out, times=np.diff(b.offsets), n_tokens=own + 1, known=known, base=base, spelled=spelled / np.log(10))
            if rare.any():
                d, w = doc[rare], h[rare]
                order = np.lexsort((w, d))
                d, w = d[order], w[order]
                new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (w[1:] != w[:-1])]))
                yield _rows(len(new), kind=np.ones(len(new), np.int32), row=rows[d[new]], word=w[new].view(np.int64), times=np.diff(np.append(new, len(d))))
            held.append((symbols, own + 1, out))
            row, size = row + n, size + len(symbols)
            if size >= group_tokens:
                yield group(first_row, held)
                first_row, held, size = row, [], 0
        if held:
            yield group(first_row, held)

    return run


# --- contexts ------------------------------------------------------------------------------

_S, _ONE = np.uint64(SYMBOL_BITS), np.uint64(1)
TWO_WORDS = np.uint64(1 << (3 * SYMBOL_BITS + 1))


def pair_keys(symbols: np.ndarray, sizes: np.ndarray, held: np.ndarray, end: int) -> list[np.ndarray]:
    """For the one and the two words before: context, symbol and whether the text is held out, as one number. Texts begin behind an end."""
    s = symbols.astype(np.uint64)
    one, two = np.full(len(s), end, np.uint64), np.full(len(s), end, np.uint64)
    one[1:], two[2:] = s[:-1], s[:-2]
    begin = np.cumsum(sizes) - sizes
    one[begin] = two[begin] = end
    two[np.minimum(begin + 1, len(s) - 1)] = end  # the place behind a begin; a text of one token has only its begin
    out = np.repeat(held.astype(np.uint64), sizes)
    key = (one << _S | s) << _ONE | out
    return [key, key | two << (_S + _S + _ONE) | TWO_WORDS]


def _group_texts(t) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return unpacked(t["symbols"], np.uint32), unpacked(t["sizes"], np.uint32).astype(np.int64), np.frombuffer(t["helds"], np.uint8)


def in_buckets(key: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each of some rising keys, and their order by bucket (then rising). A context has one bucket."""
    bucket = (mixed(key >> (_S + _ONE)) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)
    return bucket, np.argsort(bucket, kind="stable")


def _asked(end: int, buckets: int, context: int):
    """A group's pairs with one of the contexts, by bucket, with their counts in training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.to_pylist():
                key, n = np.unique(pair_keys(*_group_texts(t), end)[context], return_counts=True)
                n[(key & _ONE) > 0] = 0
                bucket, order = in_buckets(key, buckets)
                bucket, key, n = bucket[order], key[order], n[order].astype(np.uint32)
                first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
                last = np.append(first[1:], len(key))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[first].astype(np.int32)), pa.array(np.full(len(first), t["row"], np.int64)), pa.array([packed_keys(key[a:b]) for a, b in zip(first, last, strict=True)], pa.binary()),
                     pa.array([packed(n[a:b]) for a, b in zip(first, last, strict=True)], pa.binary())],
                    names=["bucket", "grp", "keys", "n"],
                )

    return run


ANSWER = "grp long, bucket int, known binary, logits binary"


def _answered(shared):
    """For each group, which of the pairs it asked a bucket for have a context that others have seen, and their logits."""

    def run(t: pa.Table) -> pa.Table:
        codes, lengths = shared.value
        keys = [unpacked_keys(x.as_py()) for x in t.column("keys")]
        n = np.concatenate([unpacked(x.as_py(), np.uint32) for x in t.column("n")])
        sizes = [len(k) for k in keys]
        every = np.concatenate(keys)
        del keys
        order = np.argsort(every)
        pair, out = every[order] >> _ONE, (every & _ONE) > 0
        new = np.concatenate([[True], pair[1:] != pair[:-1]])
        first = np.flatnonzero(new)
        at = np.empty(len(every), np.int32)
        at[order] = np.cumsum(new) - 1
        pair, total = pair[first], np.add.reduceat(n[order], first, dtype=np.int64)
        del order, new, first, every, n
        # Contexts lie together. What nobody else has seen needs no logits: an own occurrence is no knowledge.
        context = pair >> _S
        head = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        size = np.diff(np.append(head, len(pair)))
        seen = np.add.reduceat(total, head)
        of = np.repeat(np.arange(len(head)), size)
        known = seen[of[at]] - ~out > 0
        needed = np.zeros(len(head), bool)
        needed[of[at[known]]] = True
        keep = needed[of]
        symbol = (pair[keep] & ((_ONE << _S) - _ONE)).astype(np.int64)
        head = (np.cumsum(size[needed]) - size[needed]).astype(np.int64)
        length = lengths[symbol].astype(np.int64)
        full, less = path_logits(head, codes[symbol], length, total[keep])
        begin, place = np.cumsum(length) - length, np.cumsum(keep, dtype=np.int32) - 1
        both, half = np.concatenate([less, full]), len(less)
        rows, a = [], 0
        for g, m in zip(t.column("grp").to_pylist(), sizes, strict=True):
            own = slice(a, a + m)
            a += m
            if known[own].any():
                p = place[at[own][known[own]]]
                i = ragged(begin[p] + out[own][known[own]] * half, length[p])
                rows.append((g, squeezed(np.packbits(known[own]).tobytes()), squeezed(both[i].tobytes())))
        bucket = t.column("bucket")[0].as_py()
        return pa.table({"grp": pa.array([r[0] for r in rows], pa.int64()), "bucket": pa.array([bucket] * len(rows), pa.int32()), "known": pa.array([r[1] for r in rows], pa.binary()), "logits": pa.array([r[2] for r in rows], pa.binary())})

    return run


# --- scoring -------------------------------------------------------------------------------

#: From this logit on a context says much.
MUCH = 4


def says(x: np.ndarray) -> np.ndarray:
    """How much stored steps say: nothing, a little, much."""
    out = (x != 0).view(np.int8)
    out += ((x >= MUCH * STEPS) | (x <= -MUCH * STEPS)).view(np.int8)
    return out


class Scorer:
    """Costs of the tokens of a group, with weights refined from one run of tokens to the next."""

    def __init__(self, plain: np.ndarray, begin: np.ndarray, lengths: np.ndarray, logits: np.ndarray):
        self.plain, self.begin, self.lengths, self.logits = plain, begin, lengths, logits
        self.mixer = Mixer(DEPTHS * 9, [0.6, 0.4, 0.6])

    def run(self, symbols: np.ndarray, held: np.ndarray, where: list[np.ndarray]) -> np.ndarray:
        """where: of each longer context, where a token's logits begin."""
        length = self.lengths[symbols]
        order = np.argsort(~length, kind="stable")  # longest first: a bit's tokens are then a slice
        many = len(order) - np.searchsorted(np.sort(length), np.arange(int(length.max())), "right")
        at = self.begin[symbols[order]] + held[order].astype(np.int64) * (len(self.plain) // 2)
        one, two = (x[order] for x in where)
        cost = np.zeros(len(order), np.float32)
        for level, m in enumerate(many.tolist()):
            x = [self.plain.take(at[:m]), self.logits.take(one[:m]), self.logits.take(two[:m])]
            gate = (says(x[1]) * np.int8(3) + says(x[2])).astype(np.int64)
            gate += min(level, DEPTHS - 1) * 9
            cost[:m] += self.mixer.cost([y.astype(np.float32) * np.float32(1 / STEPS) for y in x], gate)
            for y in (at, one, two):
                y[:m] += 1
        out = np.empty_like(cost)
        out[order] = cost
        return out


def token_costs(symbols: np.ndarray, sizes: np.ndarray, held: np.ndarray, where: list[np.ndarray], logits: np.ndarray, code: tuple, learn_tokens: int) -> np.ndarray:
    """Natural-log cost of each token of a group. where: of each longer context, where a token's logits begin."""
    plain, begin, lengths = code
    scorer = Scorer(plain, begin, lengths, logits)
    out_of = np.repeat(held, sizes)
    runs = [slice(a, a + learn_tokens) for a in range(0, len(symbols), learn_tokens)]
    # The weights see some tokens a few times before anything is coded with them.
    for own in [slice(0, learn_tokens // 4)] * 3:
        scorer.run(symbols[own], out_of[own], [w[own] for w in where])
        scorer.mixer.learn()
    out = []
    for own in runs:
        out.append(scorer.run(symbols[own], out_of[own], [w[own] for w in where]))
        scorer.mixer.learn()
    return np.concatenate(out)


def _scored(end: int, buckets: int, shared, learn_tokens: int):
    def run(group: pa.Table, answers: pa.Table) -> pa.Table:
        if not group.num_rows:
            return pa.table({"row": pa.array([], pa.int64()), "coded": pa.array([], pa.float64())})
        t = group.select(["row", "symbols", "sizes", "helds"]).to_pylist()[0]
        symbols, sizes, held = _group_texts(t)
        code = shared.value
        lengths = code[2]
        # The pairs as they were asked for, and where each one's logits are; zeros stand in front for what nobody has seen.
        pad = int(lengths.max())
        values, at, where = [np.zeros(pad, np.int8)], pad, []
        for context, own_keys in enumerate(pair_keys(symbols, sizes, held, end)):
            key, back = np.unique(own_keys, return_inverse=True)
            bucket, order = in_buckets(key, buckets)
            first = np.searchsorted(bucket[order], np.arange(buckets + 1))
            length = lengths[((key >> _ONE) & ((_ONE << _S) - _ONE)).astype(np.int32)]
            start = np.zeros(len(key), np.int64)
            own = answers.filter(pc.equal(answers.column("context"), context))
            for b, known, logits in zip(*(own.column(c) for c in ("bucket", "known", "logits")), strict=True):
                b = b.as_py()
                asked = order[first[b] : first[b + 1]]
                asked = asked[np.unpackbits(np.frombuffer(unsqueezed(known.as_py()), np.uint8), count=len(asked)).astype(bool)]
                size = length[asked].astype(np.int64)
                start[asked] = at + np.cumsum(size) - size
                values.append(np.frombuffer(unsqueezed(logits.as_py()), np.int8))
                at += len(values[-1])
            where.append(start[back])
            del key, back, bucket, order, length, start
        cost = token_costs(symbols, sizes, held, where, np.concatenate(values), code, learn_tokens)
        coded = np.add.reduceat(cost, np.cumsum(sizes) - sizes, dtype=np.float64)
        return pa.table({"row": pa.array(t["row"] + np.arange(len(sizes))), "coded": pa.array(-coded / np.log(10))})

    return run


def score_documents(docs: DataFrame, held_out_fold: int = 2, of: int = 7, common: int = COMMON_WORDS, group_tokens: int = GROUP_TOKENS, learn_tokens: int = LEARN_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte per row of docs."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    texts = masked(docs).select("doc_id", F.col("text").cast("binary").alias("text"), (fold(F.col("doc_id"), of) == held_out_fold).alias("held"))
    texts = texts.withColumn("held", F.coalesce("held", F.lit(False)))
    train = texts.filter("NOT held")

    counted = scratch.put("counts", train.mapInArrow(_word_counts, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")))
    words = counted.filter("kind = 0").select(F.col("key").alias("word"), F.col("n").alias("c"))
    n_train = train.select("doc_id").count()
    n_words, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n, v = n_words + n_train, distinct + int(n_train > 0)
    # The commonest words and the letters (at most 2^24 rows, by the byte values) have fixed bounds.
    top = words.orderBy(F.desc("c"), "word").limit(common).toPandas().sort_values("word", key=lambda x: x.to_numpy().view(np.uint64))
    top_words, top_counts = top["word"].to_numpy(np.int64).view(np.uint64), top["c"].to_numpy(np.int64)
    letters = counted.filter("kind = 1").select("key", "n").orderBy("key").toPandas()
    code = Code(top_words, top_counts, n_train, n_words - int(top_counts.sum()))
    share = np.log10(float(n) + (v + 1))
    send = spark.sparkContext.broadcast
    looked_up = send((top_words, top_counts, code.word_symbols, code.end, code.escape, n_train, share, letter_logits(letters["key"].to_numpy(np.int64), letters["n"].to_numpy(np.int64))))
    coded = scratch.put("coded", texts.mapInArrow(_coded(looked_up, group_tokens), CODED))
    scratch.drop()

    groups = coded.filter("kind = 2").select(F.col("row").alias("grp"), "row", "symbols", "sizes", "helds")
    buckets = max(1, groups.count())
    # Groups are scored in waves, so that only a share of the answers is shuffled (and on disk twice) at a time.
    wave = F.pmod(F.xxhash64("grp"), F.lit(WAVES)).cast("int").alias("wave")
    known, answers = send((code.codes, code.lengths)), None
    for context in (1, 0):
        # One context after the other, the one with more pairs first: its pairs are gone before the other's come.
        asked = groups.mapInArrow(_asked(code.end, buckets, context), "bucket int, grp long, keys binary, n binary")
        own = asked.groupBy("bucket").applyInArrow(_answered(known), ANSWER).select("*", F.lit(context).alias("context"), wave)
        own = scratch.put(f"answers{context}", own, "wave")
        answers = own if answers is None else answers.unionByName(own)
        del asked
        scratch.drop()
    plain = send((code.plain, code.begin, code.lengths))
    scores = None
    for k in range(WAVES):
        own = groups.filter(wave == k).groupBy("grp").cogroup(answers.filter(F.col("wave") == k).drop("wave").groupBy("grp"))
        own = scratch.put(f"scores{k}", own.applyInArrow(_scored(code.end, buckets, plain, learn_tokens), "row long, coded double"))
        scores = own if scores is None else scores.unionByName(own)
        scratch.drop(f"answers0/wave={k}", f"answers1/wave={k}")

    rare = coded.filter("kind = 1").select("row", "word", "times").join(words, "word").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("rare_base"), F.sum("times").alias("rare_known"))
    out = coded.filter("kind = 0").select("row", "doc_id", "held", "times", "n_tokens", "known", "base", "spelled").join(scores, "row").join(rare, "row", "left")
    score = F.col("coded") + F.col("spelled")
    out = out.select(
        "doc_id", F.col("held").alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"), score.alias("score"),
        (-score / F.log10(F.lit(2.0)) / F.greatest("times", F.lit(1))).alias("bits_per_byte"),
    )
    return unmasked(out)
